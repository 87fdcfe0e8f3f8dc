"""Perspective rotation against brute force."""

import pytest

from aeroscope.llm import chat


def brute(rows):
    """{(conversation, perspective): (text, trained-on strings)}"""
    out = {}
    for conv in {r[0] for r in rows}:
        said = sorted(
            ((t is None, t or 0, s or "unknown", x or "") for c, t, s, x in rows if c == conv), key=lambda m: m
        )
        for me in {m[2] for m in said} - {"system", "tool"}:
            text, masks = "", []
            for _, _, speaker, body in said:
                role = "assistant" if speaker == me else speaker if speaker in ("system", "tool") else f"user name={speaker}"
                text += f"<|im_start|>{role}\n{body}<|im_end|>\n"
                if speaker == me:
                    masks.append(body + "<|im_end|>\n")
            out[conv, me] = text, masks
    return out


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hélas"), (1, 3, "cid", ""), (1, 4, "ann", None), (1, 4, "ann", "again"), (1, None, "bob", "late"),
    (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "system", "alone"), (None, 0, "x", "no id"), (None, 1, None, "no name"), (4, 5, "u", "same"), (4, 5, "u", "same"),
    (5, 0, "u", "long " * 100_000), (6, -7, "u", "negative"), (6, 3, "v", "turn"),
]


@pytest.mark.parametrize("block", [2, 4096])
def test_brute_force(spark, block):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "conv_id bigint, turn int, role string, text string, name string, place int")
    got = chat.joined(chat.rotate(df, block=block)).collect()
    assert {(r.conv_id, r.perspective): (r.text, [r.text[m.start : m.end] for m in r.masks]) for r in got} == brute(ROWS)
    assert chat.rotate(df.limit(0), block=block).count() == 0
