from loglathe.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, place string"
FIRST = "Shall we meet on Monday?\n\nThe room is booked until noon."
SECOND = "Monday is fine with me!\nI shall bring the slides."
ROWS = [
    (1, 0, "ann", FIRST),
    (1, 1, "bob", "Ann wrote:\n> Shall we meet on  monday?\n\nMonday is fine with me!\nI shall bring the slides."),
    (1, 2, "cat", "> > The room is booked until noon.\n> I shall bring the slides\nPlease bring printouts as well."),
    (1, 3, "dan", "> The room is booked until noon.\nIs there another room?"),
    (1, 4, "eve", "No quotation here at all."),
    (2, 0, "ann", "> I shall bring the slides.\nWhich slides do you mean?"),
    (2, 1, "ann", ""),
]


def _df(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_links_levels_and_own_text(spark):
    got = {(r.conv_id, r.turn): r for r in quotes.linked(_df(spark, ROWS)).collect()}
    assert {k: r.reply_to for k, r in got.items()} == {
        (1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 0, (1, 4): 3, (2, 0): None, (2, 1): 0,
    }
    assert {k for k, r in got.items() if r.by_quote} == {(1, 1), (1, 2), (1, 3)}
    assert got[1, 2].quotes == [0, 1] and got[1, 2].n_passages == 2
    assert got[1, 1].own_text == SECOND
    assert got[1, 2].own_text == "Please bring printouts as well."
    assert got[1, 0].own_text == FIRST
    assert [got[1, t].place for t in range(5)] == [1, 2, 3, 4, 5]


def test_brute_force_on_many_replies(spark):
    rows, want = [], {}
    for c in range(40):
        texts = []
        for t in range(12):
            own = f"message number {c * 100 + t} of this conversation {c}"
            target = (c * 7 + t * t) % t if t and (c + t) % 3 else None
            text = own if target is None else f"> {texts[target].upper()}\n{own}"
            texts.append(own)
            rows.append((c, t * 200, "u", text))
            want[c, t * 200] = target * 200 if target is not None else (t - 1) * 200 if t else None
    got = quotes.linked(_df(spark, rows)).collect()
    assert {(r.conv_id, r.turn): r.reply_to for r in got} == want
    assert sorted((r.conv_id, r.place) for r in got) == [(c, p) for c in range(40) for p in range(1, 13)]


def test_nulls_repeats_and_long_conversations(spark):
    rows = [(None, None, None, None), (None, None, None, None), (None, 3, "a", "x"), (7, 1, "a", "b"), (7, 1, "a", "c")]
    got = quotes.linked(_df(spark, rows)).collect()
    assert len(got) == 4 and sum(r.copies for r in got) == 5
    assert {r.reply_to for r in got if r.conv_id is None} == {None}
    assert sorted(r.place for r in got if r.conv_id == 7) == [1, 2]
    assert quotes.linked(_df(spark, []).limit(0)).collect() == []
    long = [(1, t, "a", f"turn {t}") for t in range(700)]
    parts = quotes.conversations(_df(spark, long)).collect()
    turns = [m.turn for p in sorted(parts, key=lambda p: p.part) for m in p.messages]
    assert turns == list(range(700)) and len(parts) == 3


def test_very_long_text(spark):
    text = "\n".join(f"> quoted line number {i}" for i in range(3000)) + "\nown"
    got = quotes.linked(_df(spark, [(1, 0, "a", "quoted line number 77\nrest"), (1, 1, "b", text)])).collect()
    assert [r.reply_to for r in got if r.turn == 1] == [0] and {r.own_text for r in got if r.turn == 1} == {"own"}


def test_short_passages_and_rewrapped_paragraphs(spark):
    three = "The first part is about\nthe room.\n\nThe second part is about\nthe time.\n\nThe third one is long gone."
    rows = [
        (1, 0, "ann", "Yes please"),
        (1, 1, "bob", "ok thanks"),
        (1, 2, "cat", "Something else altogether."),
        (1, 3, "dan", "> Yes please\nGood."),
        (1, 4, "eve", "> OK thanks!\n> ...\nFine."),
        (2, 0, "ann", three),
        (2, 1, "bob", "Nothing to add."),
        (2, 2, "cat", "> The first part\n> is about the room.\n>\n> The second part\n> is about the time.\nAgreed."),
    ]
    got = {(r.conv_id, r.turn): (r.reply_to, r.by_quote) for r in quotes.linked(_df(spark, rows)).collect()}
    assert (got[1, 3], got[1, 4], got[2, 2]) == ((0, True), (1, True), (0, True))
    assert not got[1, 2][1] and not got[2, 1][1]
