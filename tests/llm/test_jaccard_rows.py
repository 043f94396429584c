"""Near copies on tables with repeated and null ids."""
from fleetstream.llm import jaccard

from .conftest import as_multiset, frame


def near(tag, k):
    return " ".join([f"{tag}{x}" for x in range(80)] + [f"end{k}"])


def test_repeated_ids(spark):
    rows = [(3, near("a", 0)), (5, near("a", 1)), (5, "a text of its own that nobody else has here"),
            (7, near("b", 0)), (7, near("b", 1)), (None, near("c", 0)), (None, near("c", 1)), (None, near("d", 0)), (9, near("d", 1))]
    got = [(r.doc_id, r.text) for r in jaccard.one_of_each(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect()]
    whole = {(3, near("a", 0)), rows[2], (9, near("d", 1))}
    assert whole <= set(got) and len(got) == 5
    assert as_multiset(i for i in ([x] for x, _ in got)) == as_multiset([[3], [5], [7], [9], [None]])
