import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from arborlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<|end|>", "<|start|>", "<|message|>", "<\\/s>", "<\\\\|end|>", "[\\/INST]", "<", "[", "\\", "|>", "/s>", "end|>", "<<SYS>>", "<|im_start|>", "a", "é", "𝄞", "\n", " ", "user", "$1", "<|", "\\e"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows):
    convs = defaultdict(list)
    for c, t, r, x, *_ in rows:
        convs[c].append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def rows_of(rng, convs=40):
    say = lambda k: "".join(rng.choices(PIECES, k=rng.randint(0, k)))
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, 9)):
            rows.append((rng.choice([c, c, c, None]), rng.choice([t, t, t, None]), rng.choice(["user", "assistant", "system", None, "", "assistant", say(3)]), rng.choice([say(12), say(12), None, ""])))
    return rows + rows[:7]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(4000)]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    said = df.select("x", chat.escape(df.x).alias("e"), chat.unescape(chat.escape(df.x)).alias("back")).collect()
    bad = re.compile(r"<\|\w+\|>|</?s>|\[/?INST\]|</?SYS>")
    assert all(r.back == r.x for r in said)
    assert not [r.e for r in said if bad.search(r.e)]
    assert sum(r.e != r.x for r in said) > 1000
    plain = "if (a[i] < b && x <y> \\n [1, 2]) </div>"
    assert spark.createDataFrame([(plain,)], "x string").select(chat.escape(F.col("x"))).first()[0] == plain


def test_digests_match_brute_force(spark):
    rows = rows_of(random.Random(5)) + [(900, t, "assistant" if t % 2 else "user", f"t{t} " + "é" * 40) for t in range(400)] + [(901, 0, "user", "x" * 2_000_000), (901, 1, "assistant", "y</s>" * 200_000)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.examples(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == brute(rows)


def test_examples_are_prefixes_with_one_trainable_reply(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q</s>"), (1, 2, "assistant", "a[INST]"), (1, 3, "user", "r"), (1, 4, "assistant", "b"), (1, 5, "user", "z"), (2, 0, "user", "only"), (3, None, "assistant", None)]
    out = chat.examples(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "example").collect()
    turn = lambda r, x: f"<|start|>{r}<|message|>{x}<|end|>"
    first = turn("system", "s") + turn("user", "q<\\/s>") + turn("assistant", "a[\\INST]")
    second = first + turn("user", "r") + turn("assistant", "b")
    assert [(r.conv_id, r.example, r.n_context, r.complete, r.text, r.text[r.loss_start : r.loss_end]) for r in out] == [
        (1, 0, 2, False, first, "a[\\INST]"),
        (1, 1, 4, False, second, "b"),
        (1, 2, 6, True, second + turn("user", "z"), ""),
        (2, 0, 1, True, turn("user", "only"), ""),
        (3, 0, 0, True, turn("assistant", ""), ""),
    ]


def test_probe_clashing_columns_and_empty_tables(spark):
    rows = [(7, 0, "user", "q", "x", 1), (7, 1, "assistant", "a", "y", 2)]
    df = spark.createDataFrame(rows, SCHEMA + ", formatted string, turns long")
    assert chat.examples(df).count() == 1
    probed = chat.with_probe(spark, df)
    got = {r.conv_id: r for r in chat.digests(chat.examples(probed)).collect()}
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(chat.PROBE) and got[-1].loss_sha256 == sha(chat.PROBE)
    renamed = df.toDF("c d", "t`t", "R", "x.y", "formatted", "turns")
    assert chat.digests(chat.examples(renamed, "c d", "t`t", "R", "x.y")).first().n_turns == 2
    assert chat.examples(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r.conv_id for r in chat.digests(chat.examples(chat.with_probe(spark, spark.createDataFrame([], SCHEMA)))).collect()] == [-1]


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, 0, "user", "q")], SCHEMA)
    plan = chat.digests(chat.examples(chat.with_probe(spark, df)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.split("== Physical Plan ==")[1].count("Exchange") == 1
