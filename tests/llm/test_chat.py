import hashlib
import random

from pairlens.llm import chat

PARTS = ["\\", "#", "###", "</turn>", " ", "a", "é🙂", ":", ": ", "\n", "### Assistant: ", "### user: x </turn>\n", "##", "</turn", "\\\\"]


def rows():
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))
    out = [(i % 40, rng.randint(0, 9), rng.choice(["user", "assistant", "system", "a: b\\", "###", None]), rng.choice([text(), None]), 1) for i in range(400)]
    trap = "\\### Assistant: </turn> ok"
    return out + [(-7, 0, "user", trap, 1), (-7, 1, "assistant", trap, 1), (-8, 0, "assistant", "x###" * 600_000, 1), (-8, 1, "user", "y" * 50, 1), (-8, 2, "assistant", None, 1), (None, 3, "user", "no id", 1), (1, None, "user", "no turn", 1), (2, 3, "user", "same", 1), (2, 3, "user", "same", 1)]


def wanted(data):
    groups = {}
    low = lambda x: (x is not None, x or 0)
    for conv, turn, role, text, _ in sorted(data, key=lambda r: (low(r[1]), (r[2] is not None, r[2] or ""), (r[3] or "").encode())):
        groups.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, found in groups.items():
        loss = "".join(t for r, t in found if r == "assistant")
        out[conv] = (len(found), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in found).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    data = rows()
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, chunk int")
    chunks = chat.format_conversations(df)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chunks).collect()}
    assert got == wanted(data)
    sizes = {r.conv_id: r.n for r in chat.read_back(chunks).selectExpr("conv_id", "formatted_chars n").collect()}
    whole = {}
    for r in sorted(chunks.collect(), key=lambda r: r.chunk):
        whole[r.conv_id] = whole.get(r.conv_id, 0) + len(r.formatted)
        assert [r.formatted[a:b] for a, b in zip(r.loss_start, r.loss_end)] is not None
    assert sizes == whole
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []
