"""Formatted conversations read back exactly; examples against a loop."""

import hashlib
import random

from aisleframe.llm import chat

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "/", "s>", "INST]", "\n",
         "ok", "é", "漢", " ", "<\\s>", "[\\INST]", "<\\\\/s>", "$1", "👍"]


def made(seed=1):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 12)))
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "to\nol\\n", "</s>", "", None])
            rows.append((conv, turn, role, rng.choice([text(), text(), None, ""]), "x"))
    rows += [rows[0], rows[0], (None, None, "user", "a", "x"), (None, 1, "assistant", None, "x"),
             (900, 0, "assistant", "long " * 200_000, "x")]
    rows += [(901, t, ("user", "assistant")[t % 2], f"t{t}", "x") for t in range(700)]
    return rows


def key(r):
    return (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")


def truth(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=key)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        out[conv] = (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string, piece string"


def test_everything_reads_back(spark):
    rows = made()
    written = chat.pieces(spark.createDataFrame(rows, SCHEMA))
    got = chat.read_back(written, chat.examples(written)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == truth(rows)
    # The loss columns come from the examples: without them nothing is under the mask.
    bare = chat.read_back(written, chat.examples(written).where("target is null")).collect()
    assert {r.conv_id: r.n_turns for r in bare} == {r.conv_id: r.n_turns for r in got}
    assert not any(r.loss_chars for r in bare) and any(r.loss_chars for r in got)
    none = chat.pieces(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and chat.read_back(none, chat.examples(none)).count() == 0


def test_examples_are_prefixes_with_one_trainable_reply(spark):
    rows = [r for r in made(2) if r[0] is not None and r[0] < 60]
    written = chat.pieces(spark.createDataFrame(rows, SCHEMA))
    wanted = chat.examples(written)
    got = chat.texts(written, wanted).collect()
    total = {}
    for conv in range(60):
        mine = sorted((r for r in rows if r[0] == conv), key=key)
        replies = [k for k, r in enumerate(mine) if r[2] == "assistant"]
        ours = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.last)
        assert [r.target for r in ours if r.target is not None] == replies
        assert len(ours) == len(replies) + (not replies or replies[-1] != len(mine) - 1)
        for r in ours:
            assert r.text.count("<s>") == r.text.count("</s>\n") == r.last + 1
            assert len(r.text) == r.n_chars
            if r.target is not None:
                assert chat.unescape(r.text[r.loss_start : r.loss_end]) == (mine[r.target][3] or "")
        total[conv] = sum(r.n_chars for r in ours)
    back = chat.read_back(written, wanted).collect()
    assert {r.conv_id: r.formatted_chars for r in back} == total
