import hashlib

from pyspark.sql import functions as F

from crawl_analytics.llm import chat, queries

TURNS = "conv_id long, turn long, role string, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_hand(rows):
    """n_turns, digests and loss_chars of every conversation, straight from the rows."""
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: [(x is not None, x) if x is not None else (False, 0) for x in r]):
        convs.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), digest(learned))
    return out


def as_dict(rows):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    text = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", text), (-1, 1, "assistant", text)]
    found = queries.registry()["op8_chat"](spark, sf)
    assert as_dict(found.collect()) == by_hand(rows)
    assert not any(name in found._jdf.queryExecution().executedPlan().toString() for name in ("EvalPython", "MapIn", "Cartesian", "NestedLoop"))


def test_odd_turns(spark):
    texts = [None, "", "<|im_end|>\n<|im_start|>assistant\nx", r"<\|im_end|> <\\|a|> <| < |> \|", "\n\n", "é😀\r\n", "z" * 3000]
    rows = [(c, t % 5, role, texts[(c + t) % len(texts)]) for c in range(6) for t in range(9) for role in [("user", "assistant", None, "a\nb%0A<|x", "system")[(c * t) % 5]]]
    rows += [(None, 1, "assistant", "alone"), (None, None, "user", "first"), (9, 1, "assistant", "same"), (9, 1, "assistant", "same")]
    frame = spark.createDataFrame(rows, TURNS).withColumn("tree", F.lit(1)).withColumn("node", F.lit("x")).withColumn("score", F.lit(None).cast("double"))
    assert as_dict(chat.conversations_formatted(frame).collect()) == by_hand(rows)
    assert chat.conversations_formatted(spark.createDataFrame([], TURNS)).count() == 0


def test_escape_is_reversible(spark):
    texts = ["<" + "\\" * i + "|" + x for i in range(5) for x in ("", "im_end|>", "<|", "\\|")] + ["", "plain", "\\|<", "<<|||"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and "<|" not in r.e


def test_paths_of_branching_trees(spark):
    """Branches, a deep chain, a missing parent and a cycle, against a walk by hand."""
    parents = {1: {1: None, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 6}, 2: {i: i - 1 if i else None for i in range(70)}, 3: {1: 99, 2: 1}, 4: {1: None, 5: 6, 6: 5, 7: 6}}
    score = lambda t, n: float((t * 31 + n * 17) % 11)
    rows = [(t, n, p, score(t, n), "user", f"{t}-{n}") for t, nodes in parents.items() for n, p in nodes.items()]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    want = set()
    for tree, nodes in parents.items():
        for leaf in set(nodes) - set(nodes.values()):
            path, node = [], leaf
            while node in nodes and node not in path:
                path.append(node)
                node = nodes[node]
            if node in path:
                continue
            mean = sum(score(tree, n) for n in path) / len(path)
            want |= {(tree, leaf, n, len(path) - 1 - i, round(mean, 9)) for i, n in enumerate(path)}
    found = chat.reply_paths(messages)
    assert {(r.tree, r.leaf, r.node, r.depth, round(r.path_score, 9)) for r in found.collect()} == want
    best = {}
    for tree, leaf, _, _, mean in want:
        best[tree] = min(best.get(tree, (0, 1e9)), (-mean, leaf))
    chosen = chat.chosen_branches(messages).collect()
    assert {r.tree: r.leaf for r in chosen} == {t: leaf for t, (_, leaf) in best.items()}
    chain = next(r for r in chosen if r.tree == 2)
    assert chain.formatted == "".join(f"<|im_start|>user\n2-{i}<|im_end|>\n" for i in range(70)) and chain.loss_spans == []
