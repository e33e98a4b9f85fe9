"""Registered queries of the subpackage: each applies one operator to its whole table and derives the asked columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandlake.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str | Callable[[], str]] = {}


def query(oracle: str | Callable[[], str] | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query()
def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.order_minhash import near_classes

    return near_classes(documents(spark, sf_dir)).select("doc_id", "class_id")


@query()
def op2_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.dp_packing import pack

    p = pack(documents(spark, sf_dir))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op3_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.spaced_seeds import leaks

    return leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "start", "length", "equal")


@query()
def op4_knn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.knn_toxicity import THRESHOLD, held_out, toxicity

    scored = toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "near")


@query()
def op5_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.splitter_shards import shard

    return shard(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                                  F.lit(None).cast("int").alias("grown_shard"))


@query()
def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm import secret_ledger as S

    found = S.scan(documents(spark, sf_dir), scratch_path(spark, "secret-ledger"))
    base = S.of_kinds(F.col("spans"), *S.BASE_KINDS)
    counts = [F.size(S.of_kinds(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in S.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(S.span_text(base), 256).alias("base_sha256"),
                        S.span_text(F.col("spans")).alias("spans"))


@query()
def op7_rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.rule_filter import judge

    judged = judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query()
def op8_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.line_cleaning import assess

    return assess(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                   "base_failed", "kept")


@query()
def op9_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.token_cache import count_tokens

    counts = count_tokens(documents(spark, sf_dir), scratch_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query()
def op10_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.mixing_coder import read_ids, write_ids

    path = scratch_path(spark, "id-files")
    write_ids(documents(spark, sf_dir), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _template_sql(tree: list) -> str:
    """A parsed template as a regular expression over words that each have one space behind them."""
    out = ""
    for x in tree:
        if isinstance(x, str):
            out += x + " "
        elif isinstance(x, list):
            out += f"(?:{_template_sql(x)})?"
        else:
            out += f"(?:[^ ]+ ){{{x[0]},{x[1]}}}"
    return out


def _licenses_sql() -> str:
    from strandlake.llm import template_markup as M

    wide = {p: label for p, label in M.PHRASES.items()}
    places = [f"case when contains(s, ' {p} ') then [i - 1 for i in range(1, len(w) + 1) if w[i:i + {len(p.split()) - 1}] = "
              f"[{', '.join(repr(x) for x in p.split())}]] else [] end" for p in wide]
    trees = [(label, M.parse(t)) for _, label, t in M.TEMPLATES]
    hits = [f"case when len(p{i}) > 0 then {label!r} end" for i, label in enumerate(wide.values())]
    found = [f"regexp_matches(s, ' {_template_sql(t)}')" for _, t in trees]
    best = [f"case when len(p{i}) > 0 then {len(p.split())} else 0 end" for i, p in enumerate(wide)]
    best += [f"case when f{i} then {M.mandatory(t)} else 0 end" for i, (_, t) in enumerate(trees)]
    every = hits + [f"case when f{i} then {label!r} end" for i, (label, _) in enumerate(trees)]
    text = lambda x: f"array_to_string(list_sort(list_distinct([x for x in [{', '.join(x)}] if x is not null])), ',')"
    places_all = "flatten([" + ", ".join(f"p{i}" for i in range(len(wide))) + "])"
    return f"""with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
      j as (select doc_id, w, len(w) as n, ' ' || array_to_string(w, ' ') || ' ' as s from w),
      p as (select doc_id, n, s, {", ".join(f"{x} as p{i}" for i, x in enumerate(places))} from j),
      f as (select *, {", ".join(f"{x} as f{i}" for i, x in enumerate(found))}, {places_all} as spots from p),
      b as (select *, greatest({", ".join(best)}) as best from f)
      select doc_id, cast(n as bigint) as n_words, cast(len(spots) as bigint) as n_base, cast(list_min(spots) as bigint) as first_word,
        cast(list_max(spots) as bigint) as last_word, {text(hits)} as base_labels, {text(every)} as labels, best / (best + 1.0) as score from b"""


@query(_licenses_sql)
def op11_template_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.template_markup import scan

    return scan(documents(spark, sf_dir)).drop("matches")


@query(f"""with t as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
    q as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
      '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by 1, 2),
    tf as (select doc_id, term, count(*) as tf from t group by 1, 2),
    n as (select doc_id, count(*) as n from t group by 1),
    a as (select count(*) as docs, cast(sum(n) as bigint) as terms from n),
    w as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tf, a group by term),
    s as (select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) as bigint) as score
      from q join w using (term) join tf using (term) join n using (doc_id), a group by 1, 2)
    select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
      from s where score > 0 qualify rank <= 20""")
def op12_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.bit_sliced_search import search

    return search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query(f"""with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
    w as (select *, [x for x in string_split_regex(t, '[\x20\x09-\x0D]+') if x <> ''] as ws, min(doc_id) over (partition by t) as least from d),
    m as (select part, doc_id, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws),
        100 * (length(t) - length(translate(t, '{UPPER}', ''))) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > least] as fails from w),
    l as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as bad from labels group by 1),
    c as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (bad) as bad
      from m left join l using (doc_id) group by 1, 2),
    x as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
    o as (select concat(a.f, b.f, c.f, d.f, e.f) as filter_order from x a, x b, x c, x d, x e
      where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    r as (select c.*, filter_order, list_min([instr(filter_order, chr(64 + cast(i as int))) for i in [1, 2, 3, 4, 5] if fails[i]]) as gone from c, o),
    s as (select part, filter_order, step, cast(sum(n) filter (gone is null or gone > step) as bigint) as kept,
        cast(sum(n) filter (gone = step) as bigint) as removed,
        cast(sum(n) filter (gone < step and fails[ascii(filter_order[step]) - 64]) as bigint) as redundant,
        cast(sum(n) filter (fails[ascii(filter_order[step]) - 64] and len([y for y in fails if y]) = 1) as bigint) as unique_fails,
        cast(sum(good) filter (gone = step) as bigint) as good_lost, cast(sum(bad) filter (gone = step) as bigint) as toxic_lost
      from r, (select unnest([1, 2, 3, 4, 5]) as step) group by 1, 2, 3)
    select part, filter_order, step, coalesce(kept, 0) as kept, coalesce(removed, 0) as removed, coalesce(redundant, 0) as redundant,
      coalesce(unique_fails, 0) as unique_fails, coalesce(good_lost, 0) as good_lost, coalesce(toxic_lost, 0) as toxic_lost,
      cast(coalesce(sum(removed) over (partition by part, filter_order[step]), 0) as bigint) as shapley from s""")
def op13_removal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.removal_ranks import audit

    return audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def all_oracles() -> dict[str, str]:
    import corpus_pipeline

    made = {k: v() if callable(v) else v for k, v in ORACLES.items()}
    return made | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
