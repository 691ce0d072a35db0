"""Problems of nested documents against a walk by hand."""

import json
import random

from pyspark.sql import functions as F

from logloom.operators import validation as V

RULES = [
    ("", "object", True, None, None), ("a", "object", True, None, None), ("a.n", "number", True, 0.0, 10.0), ("a.s", "string", False, 1.0, 3.0), ("l", "array", True, 0.0, 2.0), ("l[*]", "object", False, None, None),
    ("l[*].t", "string", True, None, None), ("l[*].x", "any", False, None, None), ("m", "array", False, None, None), ("m[*]", "array", False, None, None), ("m[*][*]", "integer", False, 0.0, 5.0), ("b", "boolean", False, None, None),
]


def kind(v):
    return {dict: "object", list: "array", str: "string", int: "integer", float: "number", bool: "boolean", type(None): "null"}[type(v)]


def walk(v, path="", shape=""):
    rules = {r[0]: r for r in RULES}
    if shape not in rules:
        yield path, "unknown key"
        return
    _, want, _, least, most = rules[shape]
    got = kind(v)
    amount = v if got in ("integer", "number") else len(v) if got in ("string", "array") else None
    if want != "any":
        if got != want and not (got == "integer" and want == "number"):
            yield path, "wrong type"
        elif amount is not None and least is not None and amount < least:
            yield path, "too small"
        elif amount is not None and most is not None and amount > most:
            yield path, "too large"
    if want == "any":
        return
    dot = "." if path else ""
    if got == "object":
        for k, x in v.items():
            yield from walk(x, f"{path}{dot}{k}", f"{shape}{'.' if shape else ''}{k}")
        for s, _, required, _, _ in RULES:
            if required and s and not s.endswith("]"):
                holder, _, own = s.rpartition(".")
                if holder == shape and own not in v:
                    yield f"{path}{dot}{own}", "missing"
    if got == "array":
        for i, x in enumerate(v):
            yield from walk(x, f"{path}[{i}]", f"{shape}[*]")


def test_random_documents(spark):
    rnd = random.Random(5)

    def value(depth):
        r = rnd.random()
        if depth and r < 0.35:
            return {rnd.choice("anslmtxbz"): value(depth - 1) for _ in range(rnd.randint(0, 4))}
        if depth and r < 0.6:
            return [value(depth - 1) for _ in range(rnd.randint(0, 3))]
        return rnd.choice([1, 7, 20, 2.5, "", "ab", "abcd", True, None, "é\n"])

    docs = [{k: value(4) for k in rnd.sample("almbz", rnd.randint(0, 5))} for _ in range(150)] + ["text", 3, [1], {}, {"a": {"n": -1, "s": ""}, "l": [{"t": "x"}] * 3, "m": [[7, 1], [], [[1]]]}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, None), (901, "{bad")], "k bigint, j string").select("k", F.try_parse_json("j").alias("doc"))
    got = V.problems(df, "k", "doc", spark.createDataFrame(RULES, V.RULES)).collect()
    want = {(i, p, what) for i, d in enumerate(docs) for p, what in walk(d)}
    assert {(r.k, r.path, r.problem) for r in got} == want and len(got) == len(want)
    assert {w[2] for w in want} == {"unknown key", "wrong type", "too small", "too large", "missing"}
    assert V.problems(df.limit(0), "k", "doc", spark.createDataFrame(RULES, V.RULES)).count() == 0
