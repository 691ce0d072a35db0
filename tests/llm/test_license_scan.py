import random
import re

from logloom.llm import license_scan as L


def bigrams(text):
    w = re.sub(r"[^a-z0-9]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).split()
    return {(a, b) for a, b in zip(w, w[1:])}


def brute(text):
    out = {}
    for unit, u in enumerate([text, *text.split("\n")] if text is not None else []):
        a = bigrams(u)
        rated = [(-2 * len(a & bigrams(t)) / (len(a) + len(bigrams(t))), k) for k, t in sorted(L.TEMPLATES.items())] if a else []
        if rated and -min(rated)[0] >= L.THRESHOLD:
            out[unit] = (min(rated)[1], len(a), -min(rated)[0])
    return out


def test_equals_brute_force(spark):
    rnd = random.Random(2)
    texts = [None, "", "word", "\n\n", " ", *L.TEMPLATES.values()]
    for t in list(L.TEMPLATES.values()) * 6:
        w = t.split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(["thing", "License", "x-1", "É"])
        texts.append("some prose before it\n" * rnd.randint(0, 2) + " ".join(w).upper() + "\nand after" * rnd.randint(0, 2))
    texts.append("the the " * 50_000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("unit", L.F.lit(9)).withColumn("_row", L.F.lit(8))
    got = {}
    for r in L.scan(docs).filter("unit is not null").collect():
        got.setdefault(r.doc_id, {})[r.unit] = (r.license_id, r.n_bigrams, r.dice)
    assert got == {i: b for i, t in enumerate(texts) if (b := brute(t))}
    assert L.scan(docs.limit(0)).count() == 0
    twice = docs.filter("doc_id = 6").union(docs.filter("doc_id = 6")).withColumn("doc_id", L.F.lit(None).cast("bigint"))
    assert L.scan(twice).filter("unit is not null").count() == 2 * len(brute(texts[6]))
    assert L.scan(twice).filter("unit is null").count() == 2 * L.scan(docs.filter("doc_id = 6")).filter("unit is null").count() > 0


def test_plan_is_native_and_shuffles_nothing(spark):
    plan = L.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


PROSE = "The miller walked home along the river.\nRain fell on the roofs of the town, and nobody was in the street.\n"


def planted():
    """Texts with the template that each holds: wrapped, inside a paragraph, and whole licences in longer documents."""
    import textwrap

    out = []
    for k in ("MIT-header", "GPL-3.0-header", "ISC", "GPL-3.0", "CC-BY-SA-4.0", "Apache-2.0-header"):
        out.append((k, PROSE + "\n".join(textwrap.wrap(L.TEMPLATES[k], 40)) + "\n\n" + PROSE))
        out.append((k, PROSE * 3 + "It says here: " + L.TEMPLATES[k] + " " + PROSE.replace("\n", " ") * 3))
    for k in ("MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "MPL-2.0"):
        out.append((f"{k} text", PROSE * 20 + L.FULL_TEXTS[k] + PROSE * 20))
        out.append((f"{k} text", PROSE + L.FULL_TEXTS[k].replace("\n", " ")))
    out.append(("MIT text", L.FULL_TEXTS["MIT"][:900]))
    w = L.FULL_TEXTS["MIT"].split()
    out.append(("MIT text", PROSE + " ".join(x if i % 23 else "Changed" for i, x in enumerate(w)) + PROSE))
    return out


def test_planted_notices_are_found_where_they_are(spark):
    cases = planted()
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id bigint, text string")
    got = {}
    for r in L.scan(docs).filter("unit is null").collect():
        got.setdefault(r.doc_id, []).append(r)
    sizes = {t.id: t for t in L.stretch_templates({**L.TEMPLATES, **{f"{k} text": v for k, v in L.FULL_TEXTS.items()}})}
    for i, (name, text) in enumerate(cases):
        (r,) = [r for r in got[i] if r.license_id == name]
        w = L._plain_words(text)[r.first_word :][: sizes[name].words]
        a, b = {f"{x} {y}" for x, y in zip(w, w[1:])}, set(sizes[name].bigrams)
        assert r.n_bigrams == len(a) and r.dice == 2 * len(a & b) / (len(a) + len(b)), (name, i)
        assert r.dice >= (0.8 if i >= len(cases) - 2 else 0.9)
    assert not any(r.license_id in ("GPL-2.0", "CC-BY-4.0") for rs in got.values() for r in rs)
    assert L.scan(spark.createDataFrame([(0, PROSE * 50), (1, None)], "doc_id bigint, text string")).count() == 0


def test_planted_notices_equal_the_oracle(spark, tmp_path):
    import duckdb

    texts = [t for _, t in planted()] + [None, "", "mit", "the mit license", L.TEMPLATES["MIT"] * 30, PROSE * 400 + L.TEMPLATES["CC0-1.0"]]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3]), (None, texts[5])], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(L.ORACLES["op2_license_scan"])
    names = [d[0] for d in cur.description]
    want = sorted(str([r[names.index(c)] for c in sorted(names)]) for r in cur.fetchall())
    out = L.query(spark, str(tmp_path))
    assert sorted(str([r[c] for c in sorted(names)]) for r in out.collect()) == want and len(want) > 40


def test_telling_words_leave_too_few_bigrams_without_them():
    for t in L.stretch_templates({**L.TEMPLATES, **L.FULL_TEXTS}):
        told = t.telling()
        assert sum(not told & set(g.split(" ")) for g in t.bigrams) < t.need
