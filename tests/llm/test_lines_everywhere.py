import pytest

from leafmill.llm import lines as L
from test_lines import NOTICE, brute, frame


def site(source, first, documents, carrying):
    own = lambda d: "".join(chr(97 + int(c)) for c in f"{d:05}") * 5
    return [(source, first + d, first + d, own(first + d) + ("\n" + NOTICE if d < carrying else "")) for d in range(documents)]


@pytest.mark.parametrize(
    "rows",
    [
        site("a", 0, 60, 3),
        site("a", 0, 100, 10) + site("b", 1000, 100, 7),
        site("a", 0, 10, 10),
        site("a", 0, 60, 3) + site("b", 1000, 60, 2) + site("c", 2000, 40, 1),
        [("a", d, d, NOTICE) for d in range(3)],
    ],
    ids=["one source", "all sources", "all documents", "as frequent outside", "nothing else"],
)
def test_nothing_outside_vetoes(spark, rows):
    got = {tuple(r) for r in L.repeated_lines(frame(spark, rows)).collect()}
    assert got == brute(rows) and got
