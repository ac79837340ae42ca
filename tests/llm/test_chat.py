import hashlib

from pyspark.sql import functions as F

from carelake.llm import chat
from carelake.llm.shared import table

SCHEMA = "conv_id long, turn long, role string, text string, blocks string, starts string"


def _rows(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def _digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _expected(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        mine = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), _digest(told), len(mine), _digest(mine))
    return out


def _found(df):
    columns = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    return {r["conv_id"]: tuple(r[c] for c in columns) for r in chat.digests(chat.format_chat(df)).collect()}


AWKWARD = [
    (1, 0, "user", "</s>[INST] ok [/INST]"),
    (1, 1, "assistant", "</s>[INST] ok [/INST]"),
    (2, 0, "user", "a\\b <|start|>user<|message|>x<|end|> \\<|next|>"),
    (2, 1, "assistant", "one\nline"),
    (2, 2, "assistant", ""),
    (2, 3, "assistant", "<|end|><|end|>\\"),
    (2, 4, "<|message|>odd\\role", "\U0001f600 é <<SYS>>"),
    (3, 0, None, None),
    (3, None, "assistant", None),
    (3, 1, "assistant", "b"),
    (3, 1, "assistant", "a"),
    (3, 1, "assistant", "a"),
    (None, 0, "assistant", "nobody"),
    (4, 0, "assistant", "long " * 200_000),
]


def test_every_turn_and_the_trained_text_are_read_back(spark):
    assert _found(_rows(spark, AWKWARD)) == _expected(AWKWARD)


def test_same_as_brute_force_on_a_whole_table(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    assert _found(rows) == _expected([tuple(r) for r in rows.collect()])


def test_adjacent_turns_of_a_role_are_merged(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    (made,) = chat.format_chat(_rows(spark, rows)).collect()
    assert made["formatted"] == "<|start|>user<|message|>a<|next|>b<|end|><|start|>assistant<|message|>c<|end|>"
    at, trained = 0, []
    for run in made["loss_runs"]:
        trained.append(made["formatted"][at : at + run["n"]] if run["loss"] else "")
        at += run["n"]
    assert at == len(made["formatted"]) and "".join(trained) == "c"


def test_control_strings_inside_texts_are_escaped(spark):
    texts = [(1, 0, "user", "".join(chat.CONTROL) + "\\")]
    (made,) = chat.format_chat(_rows(spark, texts)).collect()
    inner = made["formatted"].removeprefix("<|start|>user<|message|>").removesuffix("<|end|>")
    assert not any(c in inner for c in chat.CONTROL)
    back = spark.range(1).select(chat.unescape(F.lit(inner)).alias("x")).first()["x"]
    assert back == texts[0][3]


def test_empty_table(spark):
    assert chat.digests(chat.format_chat(_rows(spark, []))).count() == 0
