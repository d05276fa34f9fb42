import hashlib

from lodebook.llm import chat
from lodebook.llm.queries import op6_chat_formatting

HARD = ["", "\\", "<", "</turn>\n", "\\</turn>", "<turn assistant>\nx</turn>\n", chat.AWKWARD, "\n\n", "\\n\\", "é\U0001F600\x00", "\ue000", "a\\<b\\\\"]


def digests(turns: list[tuple[str, str]]) -> tuple:
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def compare(rows, expected: dict) -> None:
    assert len(rows) == len(expected)
    for r in rows:
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digests(expected[r.conv_id])
        assert r.formatted_chars == len(chat.turn_template(expected[r.conv_id])) and r.n_rewritten == 0


def test_query(spark):
    expected: dict = {-7: [("user", chat.AWKWARD), ("assistant", chat.AWKWARD)]}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect():
        expected.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    compare(op6_chat_formatting(spark, "/root/testdata/sf0.001").collect(), expected)


def test_escapes_round_trip():
    for text in HARD:
        assert chat.unescape(chat.escape(text)) == text and chat.unescape(chat.escape(text, True), True) == text
    turns = [(r, t) for r in ("assistant", "a>b\n", "\\n<") for t in HARD]
    assert chat.read_back(chat.turn_template(turns)) == (turns, True)
    assert chat.read_back("<turn x>\nbroken") == ([], False)


def test_long_and_odd_conversations(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", HARD[k % len(HARD)]) for k in range(700)]
    rows += [(2, None, None, None), (2, None, None, None), (None, 3, "assistant", "late"), (None, 1, "user", "early"), (3, 0, "assistant", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", chat.F.lit(1))
    expected = {1: [(r, t) for _, _, r, t in rows[:700]], 2: [("", ""), ("", "")], None: [("user", "early"), ("assistant", "late")], 3: [("assistant", "")]}
    compare(chat.conversation_digests(chat.format_conversations(frame)).collect(), expected)
    assert chat.conversation_digests(chat.format_conversations(frame.limit(0))).count() == 0


def test_pieces_make_up_the_output(spark):
    turns = [("user", "hi <there>"), ("assistant", "yes\\"), ("user", "bye")]
    frame = spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_conversations(frame).collect(), key=lambda r: r.turn_no)
    assert "".join(r.piece for r in rows) == chat.turn_template(turns)
    assert [r.start for r in rows] == [0, len(rows[0].piece), len(rows[0].piece) + len(rows[1].piece)]
    assert [r.piece[r.loss_start:r.loss_end] for r in rows] == ["", "yes\\\\", ""]


def test_templates_that_rewrite_history_are_detected(spark):
    def counting(turns):
        return f"[{len(turns)} turns]" + "".join(f"{r}: {t}\n" for r, t in turns)

    def drops_old_thoughts(turns):
        return "".join(f"{r}: {t if k == len(turns) - 1 else t.replace('hm ', '')}\n" for k, (r, t) in enumerate(turns))

    frame = spark.createDataFrame([(1, k, "assistant", "hm yes" if k == 1 else "no") for k in range(4)], "conv_id long, turn long, role string, text string")
    flags = lambda template: [r.rewritten for r in sorted(chat.format_conversations(frame, template).collect(), key=lambda r: r.turn_no)]
    assert flags(counting) == [False, True, True, True]
    assert flags(drops_old_thoughts) == [False, False, True, False]
    assert flags(chat.turn_template) == [False] * 4


def edits_system(turns):
    return "".join(f"{r}: {t}{len(turns) if k == 0 else ''}\n" for k, (r, t) in enumerate(turns))


def begins_with_mark(turns):
    return "<begin>" + "".join(f"{r}: {t}\n" for r, t in turns)


def numbers_turns(turns):
    return "".join(f"{k} {r}: {t}\n" for k, (r, t) in enumerate(turns))


def rewrites_at_600(turns):
    return "".join(f"{r}: {'' if len(turns) > 600 and k == 3 else t}\n" for k, (r, t) in enumerate(turns))


def pieces_of(template, n, **limits):
    state, found = chat.Incremental(template, **limits), []
    turns = [("assistant" if k % 2 else "user", f"text {k} {HARD[k % len(HARD)]}") for k in range(n)]
    for turn in turns:
        found += state.add(turn)
    return turns, found + state.finish()


def test_reports_do_not_depend_on_length():
    for n in (1, 20, 80, 257, 700):
        for template in (begins_with_mark, numbers_turns, chat.turn_template, edits_system, rewrites_at_600):
            turns, found = pieces_of(template, n)
            assert "".join(p[1] for p in found) == template(turns), (n, template)
            expected = [k > 0 if template is edits_system else template is rewrites_at_600 and k == 600 for k in range(n)]
            assert [p[4] for p in found] == expected, (n, template)
            shown = lambda t: chat.escape(t) if template is chat.turn_template else t
            masked = [p[1][p[2]:p[3]] for p in found if p[0] == "assistant"]
            assert masked == [shown(t) if not (template is rewrites_at_600 and n > 600 and k == 3) else "" for k, (r, t) in enumerate(turns) if r == "assistant"]


def test_cost_and_memory_are_bounded():
    rendered = 0

    def counting(turns):
        nonlocal rendered
        rendered += len(turns)
        return chat.turn_template(turns)

    turns, found = pieces_of(counting, 4000, dense=16)
    assert "".join(p[1] for p in found) == chat.turn_template(turns) and rendered < 4000 * 400
    turns, found = pieces_of(chat.turn_template, 3000, held=2000)
    assert "".join(p[1] for p in found) == chat.turn_template(turns) and not any(p[4] for p in found)
    assert [p[0] for p in found] == [r for r, _ in turns]


def test_a_passing_rewrite_is_seen_at_every_length():
    for at, n in ((5, 20), (300, 320), (601, 700), (699, 700)):
        def passing(turns, at=at):
            return ("!" if len(turns) == at + 1 else "") + chat.turn_template(turns)

        flags = [p[4] for p in pieces_of(passing, n)[1]]
        assert flags == [k in (at, at + 1) for k in range(n)], (at, n)


def test_a_conversation_is_not_begun_anew_by_its_size():
    state, found = chat.Incremental(numbers_turns), []
    turns = [("user", "x" * (1 << 19))] * 70
    for turn in turns:
        found += state.add(turn)
    assert "".join(p[1] for p in found + state.finish()) == numbers_turns(turns)
