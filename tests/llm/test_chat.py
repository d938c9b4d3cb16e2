"""Chat windows: properties over random turn lengths, and the template's round trip."""

import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import bpe, chat

COUNT = lambda text: len(text.split())
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "assistant", "user", "tool", "system"]), st.integers(0, 400)), max_size=30)


def cost(turn):
    return COUNT("".join(chat.formed(*turn)) + "</s>")


@settings(max_examples=400, deadline=None)
@given(TURNS, st.booleans(), st.integers(50, 300), st.integers(0, 150))
def test_windows(sizes, with_system, budget, history):
    turns = [(role, f"t{i} " + "w " * n) for i, (role, n) in enumerate(sizes)]
    turns = [("system", "be kind"), *turns] if with_system else turns
    made = list(chat.windows(iter(turns), COUNT, budget, history))
    assert [t for held, n in made for t in held[n:]] == turns
    system = turns[:1] if turns and turns[0][0] == "system" else []
    for k, (held, n) in enumerate(made):
        total = 1 + sum(map(cost, held))
        fresh = [t for t in held[n:] if t not in system]
        assert fresh or len(turns) == len(system)
        assert held[: len(system)] == system
        assert total <= budget or len(fresh) <= 1 and len(held) == len(system) + len(fresh)
        assert k or n == 0
        past = held[len(system) : n]
        assert sum(map(cost, past)) <= history
        at = turns.index(held[n])
        assert not past or turns[at - len(past) : at] == past


def test_answers_stay_with_their_prompts():
    turns = [("system", "be kind")] + [(("user", "assistant")[i % 2], f"t{i} " + "w " * 60) for i in range(60)]
    made = list(chat.windows(iter(turns), COUNT, 300, 0))
    assert len(made) > 5
    for held, _ in made:
        assert all(held[i - 1][0] == "user" for i, t in enumerate(held) if t[0] == "assistant")
    big = [("system", "s " * 600), ("user", "u " * 500), ("assistant", "a " * 500), ("user", "v"), ("assistant", "b")]
    made = list(chat.windows(iter(big), COUNT, 1024, 256))
    assert [[r for r, _ in held] for held, _ in made] == [["system", "user"], ["system", "assistant"], ["system", "user", "assistant"]]


def test_tokens_of_the_encoder():
    """Windows as formatted, counted as whole texts by the encoder, keep near the budget."""
    codec, draw = bpe.codec_of(public_tokenizers.path(bpe.RANKS)), random.Random(1)
    turns = [(("user", "assistant")[i % 2], " ".join(f"w{draw.randrange(999)}<[" for _ in range(draw.randrange(1, 60)))) for i in range(80)]
    for held, n in chat.windows(iter(turns), lambda t: len(codec.encode(t)) // 4, 1024, 256):
        assert len(codec.encode(chat.window(held, n)[0])) // 4 <= 1024 + len(held) or len(held) == 1


def test_template():
    for t in ("\\", "[INST]", "</s>\\(", "a\\{b", "\n[/INST]\r\n", ""):
        assert chat.unescape(chat.escape(t)) == t and not set("[<") & set(chat.escape(t))
    held = [("sy[st]em", "</s>"), ("user", "[INST]\\"), ("assistant", "ok </s>")]
    text, loss = chat.window(held, 0)
    assert [(chat.unescape(a), chat.unescape(b)) for a, b in chat.TURN.findall(text)] == held
    assert [chat.unescape(text[a:b]) for a, b in loss] == ["ok </s>"]
