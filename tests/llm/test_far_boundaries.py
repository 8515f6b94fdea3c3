from leafmill.llm import pieces as P


def test_a_far_boundary_goes_before_a_hard_cut():
    text = "Some words stand here in a row. " * 4
    text += "x" * (420 - len(text))
    got = P.cut(text, 400, 0)
    assert got == [(0, 128, P.KINDS.index("sentence")), (128, 420, 0)]
    # out of the range that the limit allows: the rest wouldn't fit
    assert P.cut("a b " + "x" * 416, 400, 0)[0][2] == 0
