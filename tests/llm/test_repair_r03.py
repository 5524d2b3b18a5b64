"""What the test report of round 3 showed: stacks that could not win stayed, and no made document had a form of a form."""


def test_only_stacks_that_can_win_stay():
    """The stack that deletes every row goes soon, and cost and audit stay those of every string of edits."""
    import random

    from tessera.llm import repair

    from test_round3 import NAMES, plain_repair

    parser = repair.Repairer()
    for k in range(400):
        parser.take("user" if k % 2 == 0 else "assistant", "x", False, False)
    assert len(parser.settled()) > 380
    rng = random.Random(9)
    for _ in range(150):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "t"]), rng.random() < 0.15, rng.random() < 0.2) for _ in range(7)]
        parser = repair.Repairer()
        for initial, delete, cut in rows:
            parser.take(NAMES[initial], "x", delete, cut)
        cost, edits = parser.finish()
        assert (cost, "".join(e.action for e in edits)) == plain_repair(rows)


def test_roots_follow_several_forms(spark):
    """A word whose form has a form, which the made documents of the other test don't hold."""
    from tessera.llm import spelling

    from test_round3 import plain_variants

    rows = [(k, "alphabets " * 10) for k in range(400)] + [(k, "alphabats " * 3) for k in range(1000, 1040)] + [(2000, "alphbats " * 4)]
    want = plain_variants(rows)
    assert any(form and root != form for form, root, *_ in want.values())
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
