"""Documents without text or letters, and joins that send few rows."""

import os
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _duck():
    try:
        import duckdb
    except ImportError:
        sys.path.append("/opt/oracle")
        duckdb = pytest.importorskip("duckdb")
    return duckdb.connect()


def _odd_documents(tmp_path):
    """The given documents, some of them without text, without letters or of a letter or two."""
    con = _duck()
    con.execute(f"""copy (select * replace (case when doc_id in (5, 8) then null when doc_id in (9, 16, 31) then ''
        when doc_id = 17 then '123 45' when doc_id = 33 then 'ab' when doc_id = 50 then repeat('a', 70) else text end as text)
        from '{SF}/documents.parquet') to '{tmp_path}/documents.parquet' (format parquet)""")
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    return con


def _same_as_sql(spark, con, sf_dir, name):
    from tools.check import rows_of

    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall()) and got[0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
@pytest.mark.parametrize("name", ["read_embl", "read_genbank", "concat_windows_to_contigs"])
def test_documents_without_text_or_letters(spark, tmp_path, name):
    _same_as_sql(spark, _odd_documents(tmp_path), str(tmp_path), name)


def test_search_at_a_contig_end_and_over_chunks(spark):
    from strandlake.operators import sequence as sq

    words = spark.createDataFrame([("GGGCCC",), ("ACGTACGTAC",), ("TT",)], "pattern string")
    seqs = {"end": "AAGGGCCC", "long": "ACGTACGTAC" * 3 + "TTT", "none": "", "short": "T"}
    contigs = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    want = []
    for chrom, s in seqs.items():
        for p, rc in (("GGGCCC", None), ("ACGTACGTAC", "GTACGTACGT"), ("TT", "AA")):
            for strand, w in (("+", p), ("-", rc)):
                want += [(chrom, p, strand, i) for i in range(len(s)) if w and s.startswith(w, i)]
    for step in (3, 8, 1 << 16):
        got = sq.dna_search(contigs, words, step=step)
        assert sorted((r.chrom, r.pattern, r.strand, r.start_bp) for r in got.collect()) == sorted(want)


def _anchors(spark):
    """Anchors with copies, ties, gaps and two strands; contig y is longer than x."""
    import random

    rng, rows = random.Random(5), []
    for chrom, size in (("x", 900), ("y", 4000)):
        for same in (True, False):
            q = t = 0
            while q < size:
                q, t = q + rng.choice((0, 5, 40, 25000 if rng.random() < 0.01 else 9)), t + rng.choice((0, 5, 40, 300))
                rows += [("a", "b", chrom, "z", same, q, t + 7, t)] * rng.choice((1, 1, 2))
    return spark.createDataFrame(rows, "q_genome string, t_genome string, q_chrom string, t_chrom string, same_strand boolean, "
                                       "q_pos int, t_pos int, t_trans int")


def test_chains_of_short_and_long_contigs_agree(spark, monkeypatch):
    from strandlake.operators import compare as cp

    a = cp.bucket_anchors(_anchors(spark))
    cols = [*cp.CHAIN, "q_pos", "t_pos", "t_trans", "prev_q", "prev_t"]
    rows = lambda df: sorted(tuple(str(v) for v in r) for r in df.select(*cols).collect())
    short = cp.chain_anchors(a)
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    want = rows(cp._long_chains(a, cp.K))
    assert rows(short) == want and want
    monkeypatch.setattr(cp, "STEP", 2000)  # y is long, x is not
    assert rows(cp.chain_anchors(a)) == want


def test_seeds_meet_without_salts_unless_a_key_is_hot(spark):
    from strandlake.operators import sequence as sq

    asked = spark.range(2000).selectExpr("id % 50 as k", "id")
    table = spark.range(50).selectExpr("id as k", "id * 2 as v")
    hint = table.hint("merge")
    cold = sq.salted_join(asked, hint, ["k"], ["id"])
    assert cold._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    assert sorted(map(tuple, cold.collect())) == [(i % 50, i, i % 50 * 2) for i in sorted(range(2000), key=lambda i: (i % 50, i))]
    assert sq.salted_join(asked, hint, ["k"], ["id"], pile=10).count() == 2000


def test_groups_over_batches_are_folded_once():
    import numpy as np
    import pandas as pd

    from strandlake.operators.compare import _each_group

    rows = pd.DataFrame({"k": ["a"] * 3 + ["b"] + ["c"] * 5 + ["d"] * 2, "j": [0] * 4 + [0, 0, 0, 1, 1] + [1] * 2, "v": np.arange(11)})
    want = rows.groupby(["k", "j"])["v"].sum().reset_index().values.tolist()
    for size in (1, 2, 3, 4, 11):
        batches = [rows.iloc[i:i + size].reset_index(drop=True) for i in range(0, 11, size)]
        got = pd.concat(_each_group(lambda g: {"v": [int(g["v"].sum())]}, ["k", "j"])(iter(batches)))
        assert got.values.tolist() == want


def test_equal_gaps_are_aligned_once(monkeypatch):
    import pandas as pd

    from strandlake.operators import align, compare as cp

    asked = []
    real = align.align_many
    monkeypatch.setattr(align, "align_many", lambda q, t, wide: asked.extend(q) or real(q, t, wide))
    gaps = pd.DataFrame({"id": [1, 2, 3], "q_seq": ["ACGT", "ACG", "ACGT"], "t_seq": ["ATTTT", "AG", "ATTTT"]})
    out = next(iter(cp._align_rows(False)([gaps])))
    assert sorted(asked) == ["ACG", "ACGT"] and out["ops"].tolist() == real(gaps["q_seq"].tolist(), gaps["t_seq"].tolist())
