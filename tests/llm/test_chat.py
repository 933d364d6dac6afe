from auditloom.llm.chat import link_quotations

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def test_quotes_link_to_originals_and_vanish(spark):
    rows = [
        (1, 0, "user", "Where is the Station?\n\nAnd the bus?", "x"),
        (1, 1, "assistant", "> where is  the station?\nOver there.", "x"),
        (1, 2, "user", "> And the bus?\nI still ask.", "x"),
        (1, 3, "assistant", "On Monday Ann wrote:\n>> where is the station?\n> Over there.\nYes, there.", "x"),
        (1, 4, "user", "> nobody said this\nHm.", "x"),
        (2, 7, "user", None, "x"),
        (None, 1, "user", "lost", "x"),
        (2, 7, "user", None, "x"),
    ]
    got = link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == len(rows)
    assert [by[1, t].parent_turn for t in range(5)] == [None, 0, 0, 1, 3]
    assert [by[1, t].depth for t in range(5)] == [0, 1, 1, 2, 3]
    assert [by[1, t].linked for t in range(5)] == [False, True, True, True, False]
    assert by[1, 3].text == "Yes, there." and by[1, 1].text == "Over there." and by[1, 4].text == "Hm."
    assert by[1, 3].n_quoted == 2 and all(by[1, t].root_turn == 0 for t in range(5))
    assert by[2, 7].text == "" and by[2, 7].depth == 0 and by[2, 7].parent_turn is None
    assert by[None, 1].parent_turn is None and not by[None, 1].linked


def test_long_chain_and_empty_table(spark):
    chain = [(5, t, "user", f"message {t}", "") for t in range(0, 9000, 7)]
    got = link_quotations(spark.createDataFrame(chain, SCHEMA)).collect()
    assert max(r.depth for r in got) == len(chain) - 1 and {r.root_turn for r in got} == {0}
    assert link_quotations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_and_repeated_turns(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    rows = [(1, 0, "u", long, ""), (1, 1, "a", "> line 19999\nyes", ""), (1, 1, "a", "> line 19999\nyes", ""), (1, 2, "u", "> yes\n" * 3, "")]
    got = link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 and [r.parent_turn for r in sorted(got, key=lambda r: r.turn)] == [None, 0, 0, 1]
    assert max(len(r.text) for r in got) == len(long)


def test_originals_in_other_stretches_are_found(spark):
    rows = [(1, t, "u", "same words" if t in (3, 5000) else "> same words\nyes" if t in (4, 4500, 9000, 5001) else f"turn {t}", "") for t in (0, 3, 4, 4500, 5000, 5001, 9000)]
    got = {r.turn: (r.parent_turn, r.linked) for r in link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[4] == (3, True) and got[4500] == (3, True) and got[5001] == (5000, True) and got[9000] == (5000, True) and got[5000] == (4500, False)
