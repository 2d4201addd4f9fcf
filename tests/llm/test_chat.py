"""Chat grammar: exact round trips, digests against a direct computation, edge rows."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm.chat import escaped, format_turns, parse, read_back, render

TOKENS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<TEXT>>",
          "<</ROLE>>", "<<NULL>>", "\\", "<", "[", "/", "s>", "SYS>>", "INST]", "<\\s>", "a", "\n"]
TEXT = st.lists(st.sampled_from(TOKENS), max_size=12).map("".join) | st.text(max_size=20)
ROLE = st.sampled_from(["user", "assistant", "system", None, "tool", ""]) | TEXT


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=5))
def test_round_trip(turns):
    assert parse("".join(render(r, t) for r, t in turns)) == turns


def test_only_conflicts_are_escaped():
    assert render("user", "a < b [x] \\ c") == "[INST]a < b [x] \\ c[/INST]"
    assert render("assistant", "</s>") == "<s><\\/s></s>"
    assert escaped("<\\s>") == "<\\\\s>"


def test_digests_and_edges(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>yes"), (1, 2, "assistant", None),
            (2, 5, "assistant", "b"), (2, -1, "system", "😀" * 5), (2, None, None, "n"),
            (None, 0, "tool", "x"), (None, 1, "user", ""), (3, 0, "user", "dup"), (3, 0, "user", "dup"),
            (4, 0, "assistant", "long " * 100_000)]
    df = spark.createDataFrame(
        [(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, rendered int"
    )
    got = {r.conv_id: r for r in read_back(format_turns(df)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        turns = sorted(
            (x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0)
        )
        body = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256(body.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(render(x[2], x[3] or "")) for x in turns)
    assert read_back(format_turns(df.limit(0))).count() == 0
