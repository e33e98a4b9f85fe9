from strandlake.llm import line_cleaning as L


def test_each_mark_of_navigation_counts_alone():
    for mark in "|»>":
        line = f" {mark} ".join(["Home page", "Books and maps", "Old maps of towns", "North"])
        assert L.line_fault(line) == "navigation"
    assert L.line_fault("« One sentence of five words » and no more than that.") is None
