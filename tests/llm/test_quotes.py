"""Quotes that are wrapped otherwise than what they quote."""

from lidarloom.llm import quotes


def test_rewrapped_quotes(spark):
    rows = [
        (1, 0, "u", "Yes."), (1, 1, "u", "The index is rebuilt each night because the loader\ndrops it first, which takes an hour or so.\nYes."),
        (1, 2, "u", "> The index is rebuilt each night\n> because the loader drops it first, which takes\n> an hour or so.\n> Yes.\nCan it be kept?"),
        (1, 3, "u", "> Can it\n> be kept?\nOnly by hand."), (1, 4, "u", ">> Can it be\n>> kept?\n> Only\n> by hand.\n\nFine."),
        (2, 0, "u", "one two three four five six seven eight"), (2, 1, "u", "> one two three four\nno\n> five nine"),
    ]
    by = {(x.conv_id, x.turn): x for x in quotes.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert by[(1, 2)].parent_turn == 1 and by[(1, 2)].n_linked == 4 == by[(1, 2)].n_quoted
    assert by[(1, 3)].parent_turn == 2 and by[(1, 4)].parent_turn == 3 and by[(1, 4)].root_turn == 1 and by[(1, 4)].n_linked == 4
    assert by[(2, 1)].parent_turn is None


def test_only_linked_quotes_go(spark):
    """Lines that quote nothing known stay, and texts without a link stay byte for byte."""
    code = "  def f():\r\n\n\n\n    pass \n"
    rows = [
        (1, 0, "u", ">>> import os\nprint(1)"), (1, 1, "u", code), (1, 2, "u", "> print(1)\n\nNo.\n\n> something never said here\nEnd"),
        (1, 3, "u", "First line here\n\n> No.\n"), (1, 4, "u", None), (2, 0, "u", "> alone"),
    ]
    by = {(x.conv_id, x.turn): x for x in quotes.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert by[(1, 0)].text == rows[0][3] and by[(1, 0)].n_linked == 0
    assert by[(1, 1)].text == code and by[(1, 4)].text == "" and by[(2, 0)].text == "> alone"
    assert by[(1, 2)].text == "No.\n\n> something never said here\nEnd" and (by[(1, 2)].parent_turn, by[(1, 2)].n_linked, by[(1, 2)].n_quoted) == (0, 1, 2)
    assert by[(1, 3)].text == "First line here\n" + "" or by[(1, 3)].text.rstrip() == "First line here"


def plain_links(messages):
    """For each message of a conversation the lines that link and to which turn, word by word: each quoted line goes to the
    message that most five-word windows over it were first said in, else to the first that said the line or the short
    passage."""
    import re

    def units(text):
        lines = []
        for k, line in enumerate((text or "").split("\n")):
            marks = re.match(r"^[ \t]*>(?:[ \t]*>)*", line)
            level = marks[0].count(">") if marks else 0
            words = (line[marks.end() :] if marks else line).lower().split()
            if words:
                lines.append((k, level, words))
        out = [(level, {k}, False, " ".join(words)) for k, level, words in lines]
        passages = []
        for k, level, words in lines:
            if not passages or passages[-1][0] != level:
                passages.append((level, []))
            passages[-1][1].extend((w, k) for w in words)
        for level, words in passages:
            if len(words) < 5:
                out.append((level, {k for _, k in words}, False, " ".join(w for w, _ in words)))
            for i in range(len(words) - 4):
                part = words[i : i + 5]
                out.append((level, {k for _, k in part}, True, " ".join(w for w, _ in part)))
        return out

    said = {}
    for turn, text in sorted(messages):
        for level, _, _, words in units(text):
            if level == 0:
                said.setdefault(words, turn)
    found = {}
    for turn, text in messages:
        votes = {}
        for level, lines, wide, words in units(text):
            if level > 0 and said.get(words, turn) < turn:
                for k in lines:
                    of = votes.setdefault(k, {})
                    of[said[words]] = of.get(said[words], 0) + wide
        found[turn] = {k: max(of, key=lambda t: (of[t], -t)) for k, of in votes.items()}
    return found


def test_random_threads_against_plain_links(spark):
    import random

    r = random.Random(5)
    vocabulary = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    rows = []
    for conv in range(40):
        texts = []
        for turn in range(7):
            parts = []
            for _ in range(r.randrange(1, 4)):
                if texts and r.random() < 0.6:  # quotes some lines of an earlier message, wrapped anew
                    words = " ".join(x.lstrip("> ") for x in r.choice(texts).split("\n")).split()
                    a = r.randrange(max(1, len(words)))
                    words, width = words[a : a + r.randrange(2, 16)], r.randrange(3, 9)
                    parts += ["> " * r.randrange(1, 3) + " ".join(words[i : i + width]) for i in range(0, len(words), width)]
                else:
                    parts += [" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 4))]
            texts.append("\n".join(parts))
        rows += [(conv, turn, "u", t) for turn, t in enumerate(texts)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for x in quotes.linked_lines(m).collect():
        got.setdefault((x.conv_id, x.turn), {})[x.line] = x.source_turn
    for conv in range(40):
        want = plain_links([(t, text) for c, t, _, text in rows if c == conv])
        for turn, lines in want.items():
            assert got.get((conv, turn), {}) == lines, (conv, turn)
    assert sum(map(len, got.values())) > 150
