"""Event logs to rendered conversations and back."""

import hashlib
import random

from banfleet.llm import chat


def test_escapes_are_reversible():
    draw = random.Random(2)
    for _ in range(2000):
        role, text = ("".join(draw.choice("\\#<>/ab:\n turn") for _ in range(draw.randint(0, 25))) for _ in range(2))
        formatted, start, end = chat.render(role, text)
        assert chat.read(formatted) == (role, text)
        assert chat.unescape(formatted[start:end]) == text
        assert chat.CLOSE not in formatted[start:end] and chat.OPEN not in formatted[start:end]


LOG = [
    (1, 0, 0, "message", "user", "hi"),
    (1, 1, 1, "message", "assistant", ""),
    (1, 1, 3, "delta", None, " world"),
    (1, 1, 2, "delta", None, "hello"),
    (1, 2, 4, "message", "user", "again"),
    (1, 2, 5, "edit", None, "again, please"),
    (1, 3, 6, "message", "assistant", "bad"),
    (1, 3, 7, "regenerate", None, None),
    (1, 3, 8, "delta", None, "good"),
    (1, 4, 9, "message", "user", "oops"),
    (1, 4, 10, "delete", None, None),
    (1, 3, 11, "something", None, "else"),
    (2, 0, 0, "message", None, None),
    (2, 0, 0, "message", None, None),
    (None, 0, 0, "message", "assistant", "x"),
    (3, 5, 0, "message", "assistant", "long \\#< " * 30000),
]


def test_events_fold_into_messages(spark):
    log = spark.createDataFrame(LOG, chat.EVENTS).selectExpr("*", "'x' AS formatted")
    got = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.render_conversations(log).collect()]
    assert [x for x in got if x[0] == 1] == [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello world"), (1, 2, "user", "again, please"), (1, 3, "assistant", "good"),
    ]
    assert [x for x in got if x[0] == 2] == [(2, 0, "", "")] * 2
    assert [x for x in got if x[0] is None] == [(None, 0, "assistant", "x")]
    back = {r["conv_id"]: r for r in chat.read_back(chat.render_conversations(log)).collect()}
    assert back[1]["n_turns"] == 4 and back[1]["loss_chars"] == len("hello worldgood")
    assert back[1]["loss_sha256"] == hashlib.sha256(b"hello worldgood").hexdigest()
    assert back[3]["loss_chars"] == 9 * 30000
    assert chat.render_conversations(log.limit(0)).count() == 0 == chat.read_back(chat.render_conversations(log.limit(0))).count()
