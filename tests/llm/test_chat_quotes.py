import random

from brinemark.llm.chat_quotes import introduces, link_quotes, op4_chat_quotes, split_levels

SCHEMA = "conv_id long, turn long, role string, text string, thread string"


def quote(text, by=1):
    return "\n".join(">" * by + " " + x for x in text.split("\n"))


def test_levels():
    assert split_levels("a\n> b\n>> c\n> > d\nOn Monday, X wrote:\n> e\nf") == [(0, "a"), (1, "b"), (2, "c\nd"), (0, ""), (1, "e"), (0, "f")]
    assert split_levels("") == [(0, "")] and split_levels("| a | b |") == [(0, "| a | b |")]


def test_links_threads_and_text(spark):
    rows = [
        (1, 0, "user", "How warm is the northern sea in winter?", "x"),
        (1, 1, "assistant", "About four degrees.\n\nIt differs by place and by depth of water.", "x"),
        (1, 2, "user", quote("How warm is the northern sea in winter?") + "\nAnd in summer?", "x"),
        (1, 3, "assistant", quote("And in summer?") + "\n" + quote("how  warm is the NORTHERN sea in winter?", 2) + "\nFifteen.", "x"),
        (1, 4, "user", quote("It differs by place and by depth of water.") + "\n" + quote("never said") + "\nI see.", "x"),
        (2, 0, "user", quote("How warm is the northern sea in winter?"), "x"),
        (2, 1, None, None, "x"),
        (None, 0, "user", "> lone\nmine", "x"),
        (3, 0, "user", "same", "x"),
        (3, 0, "user", "same", "x"),
    ]
    out = link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {(r.conv_id, r.turn): r for r in out}
    assert len(out) == len(rows)
    assert [got[1, t].reply_to for t in range(5)] == [None, None, 0, 2, 1]
    assert [got[1, t].thread for t in range(5)] == [0, 1, 0, 0, 1]
    assert got[1, 2].text == "And in summer?" and got[1, 3].text == "Fifteen." and got[1, 4].text == "I see."
    assert got[1, 3].quoted == [0, 2] and (got[1, 4].n_quotes, got[1, 4].n_unlinked) == (1, 0)
    assert got[2, 0].text == "" and got[2, 0].n_unlinked == 1 and got[2, 1].text == "" and got[None, 0].text == "mine"
    assert got[1, 1].text == rows[1][3]
    assert link_quotes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(8)
    rows, parent = [], {}
    for c in range(40):
        own = []
        for t in range(r.randint(1, 25)):
            text = f"message {c} {t} " + " ".join(r.choice(["sea", "warm", "deep"]) for _ in range(8))
            parent[c, t] = r.randrange(t) if t and r.random() < 0.5 else None
            rows.append((c, t, "user", (quote(own[parent[c, t]]) + "\n" if parent[c, t] is not None else "") + text, "x"))
            own.append(text)
    r.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    out = op4_chat_quotes(spark, str(tmp_path)).collect()

    def root(k):
        return k[1] if parent[k] is None else root((k[0], parent[k]))

    assert {(x.conv_id, x.turn): (x.reply_to, x.thread) for x in out} == {k: (p, root(k)) for k, p in parent.items()}
    assert all(">" not in x.text and x.chat.startswith("<|user|>\nmessage") for x in out)
    for c in range(40):
        order = [x.turn for x in sorted((x for x in out if x.conv_id == c), key=lambda x: (x.thread, x.turn))]
        assert all(parent[c, t] is None or order.index(parent[c, t]) < order.index(t) for t in order)


def test_short_lines_link_and_longer_passages_decide(spark):
    rows = [
        (1, 0, "user", "We meet by the pier.\nAt five then\nBring the nets.", "x"),
        (1, 1, "user", "Thanks\nNot now.", "x"),
        (1, 2, "user", quote("At five then") + "\nFine.", "x"),
        (1, 3, "user", quote("We meet by the pier.\nThanks") + "\nGood.", "x"),
        (1, 4, "user", quote("At six") + "\nNo.", "x"),
    ]
    got = {r.turn: r for r in link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[t].reply_to for t in range(5)] == [None, None, 0, 0, None]
    assert got[2].thread == 0 and got[2].n_unlinked == 0 and got[4].n_unlinked == 1


def test_introductions_of_any_length():
    for line in ("On Monday Ann wrote:", "Am 3. Mai um 10:30 schrieb Bo:", "Le 3 mai, " + "x " * 400 + "a écrit :", "on 1 May " + "<a@b.c> " * 60 + "wrote" + " y" * 80 + ":"):
        assert introduces(line), line
    for line in ("Only she wrote:", "On Monday Ann wrote", "He wrote on:", "On that he wrote: see here:"):
        assert not introduces(line), line
