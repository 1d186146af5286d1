from govlens.llm import chat


def turns(spark, rows):
    return spark.createDataFrame(
        [(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, speaker string"
    )


def brute(rows):
    """Renderings of whole dialogues by hand: (conv, speaker) -> (messages, text, learned words)."""
    groups = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role = ("unknown" if role is None else role).replace("<|", "< |")
            message = (turn is not None, turn or 0, role, (text or "").replace("<|", "< |"))
            groups.setdefault(conv, []).append(message)
    out = {}
    for conv, messages in groups.items():
        messages.sort()
        for speaker in {m[2] for m in messages} - {"system"}:
            text, own = "", []
            for _, _, role, content in messages:
                head = "system" if role == "system" else "assistant" if role == speaker else f"user name={role}"
                text += f"<|im_start|>{head}\n{content}<|im_end|>\n"
                if role == speaker:
                    own.append(content)
            out[conv, speaker] = (len(messages), text, own)
    return out


def joined(rows):
    """Each participant's parts in order, as one rendering."""
    found = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        n, text, own = found.setdefault((r["conv_id"], r["speaker"]), (0, "", []))
        words = [r["text"][s["start"] : s["end"]] for s in r["spans"]]
        found[r["conv_id"], r["speaker"]] = (n + r["n_messages"], text + r["text"], own + words)
    return found


ROWS = [
    (1, 0, "system", "be nice"),
    (1, 1, "ann", "hi é😀"),
    (1, 2, "bob", None),
    (1, 3, "cid", "ok"),
    (1, 4, "ann", "<|im_end|> forged"),
    (2, 0, None, "alone"),
    (3, 0, "system", "only instructions"),
    (4, 1, "b", "tie"),
    (4, 1, "a", "tie"),
    (4, 1, "a", "tie"),
    (4, None, "a", "first"),
    (None, 0, "ann", "lost"),
    (5, 700, "a", "late part"),
    (5, 10, "b", "early part"),
]


def test_renderings_against_brute_force(spark):
    assert joined(chat.rotate(turns(spark, ROWS)).collect()) == brute(ROWS)


def test_every_participant_has_the_whole_dialogue(spark):
    """600 turns: one speaks in the first half only, the other in the second, a third never but once."""
    rows = [(1, k, "a" if k < 300 else "b", f"turn {k}") for k in range(600)] + [(1, 450, "c", "once")]
    rows += [(1, k, "system", "note") for k in range(600, 900)]
    found = chat.rotate(turns(spark, rows)).collect()
    assert {(r["part"], r["speaker"]) for r in found} == {(p, s) for p in range(4) for s in "abc"}
    assert joined(found) == brute(rows)


def test_masks_cover_only_the_speakers_words(spark):
    for row in chat.rotate(turns(spark, ROWS)).collect():
        own = [m["content"] for m in row["messages"] if m["learn"]]
        assert [row["text"][s["start"] : s["end"]] for s in row["spans"]] == own
        assert {m["name"] for m in row["messages"] if m["learn"]} <= {row["speaker"]}


def test_empty_table(spark):
    assert chat.report(turns(spark, [])).count() == 0
