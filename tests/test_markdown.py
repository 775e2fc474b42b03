"""Chunks by DataFrames equal those of the walk over one document."""

import random

from docgrove.model import ChunkConfig
from docgrove.operators import chunking as ch
from docgrove.operators.markdown import changelog_chunks_of, section_chunks

SMALL = ChunkConfig(300, 60, 150)


def document(rng):
    lines = []
    for _ in range(rng.randrange(40)):
        k = rng.random()
        if k < 0.3:
            lines.append("#" * rng.randint(1, 6) + " " + rng.choice(["Head", "API", "Introduction", "Documentation", "1.2.3 (new)", "`code` **b**", "Long heading", "x"]))
        elif k < 0.36:
            lines += ["```", *["code " * rng.randrange(12)] * rng.randrange(1, 9), "```"]
        elif k < 0.4:
            lines.append("URL: https://d.example/" + str(rng.randrange(5)) + ".")
        else:
            lines.append(rng.choice(["", "text " * rng.randrange(1, 30), "word " * rng.randrange(3), "> quote", "é\U0001f600 " * 9, "\xa0 tail \r"]))
    return "\n".join(lines)


def test_readme_and_migration_rules(spark):
    rng = random.Random(8)
    texts = [document(rng) for _ in range(150)] + [None, "", "plain " * 30, "# Only\n", "## A\n" + "w " * 500]
    rows = [(i if i else None, f"ctx{i % 3}" if i % 4 else "", t, f"https://f.example/{i}" if i % 5 else "", "en") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "id int, context string, content string, url string, language string")
    for migration, rule in ((False, ch.readme_chunks), (True, ch.migration_chunks)):
        for config in (SMALL, ChunkConfig()):
            got = {}
            for r in section_chunks(docs, config=config, migration=migration).collect():
                got.setdefault(r.id, []).append(r)
            for i, context, text, url, language in rows:
                expected = rule(text or "", url, context, language, config)
                found = [r.asDict(recursive=True) for r in sorted(got.get(i, []), key=lambda r: r["index"])]
                assert [{k: f[k] if k != "id" else f["chunk_id"] for k in e} for f, e in zip(found, expected)] == expected and len(found) == len(expected)
    assert any(r.heading.endswith("(continued)") for r in section_chunks(docs, config=SMALL).collect())


def changelog(rng):
    out = [rng.choice(["", "Intro text here.\n", "# 1.0\nno version\n"])]
    for _ in range(rng.randrange(14)):
        head = rng.choice(["## ", "# ", "##", "### ", "## [v", "## v"]) + f"{rng.randrange(9)}.{rng.randrange(9)}.0" + rng.choice(["", "]", "] - 2024", " (beta)"])
        body = rng.choice(["", "- fix\n" * rng.randrange(12), "text " * rng.randrange(90), "a\n```\n" + "code\n" * rng.randrange(60) + "```\n" + "b " * rng.randrange(200)])
        out.append(f"{head}\n{body}\n")
    return rng.choice(["", "\r"]).join(out)


def test_changelog_rules(spark):
    rng = random.Random(9)
    rows = [(i, f"ctx{i % 3}", changelog(rng), f"https://f.example/{i}", "en") for i in range(140)] + [(900, "c", None, "u", "en"), (901, "c", "## 1.2.3", "u", "en")]
    docs = spark.createDataFrame(rows, "id int, context string, content string, url string, language string")
    for config, keep in ((SMALL, False), (SMALL, True), (ChunkConfig(), False), (ChunkConfig(100, 60, 95), False)):
        got = {}
        for r in changelog_chunks_of(docs, config=config, keep_all=keep).collect():
            got.setdefault(r.id, []).append(r)
        for i, context, text, url, language in rows:
            expected = ch.changelog_chunks(text or "", url, context, language, config, keep_all=keep)
            found = [r.asDict(recursive=True) for r in sorted(got.get(i, []), key=lambda r: r["index"])]
            assert [{k: f[k] if k != "id" else f["chunk_id"] for k in e} for f, e in zip(found, expected)] == expected and len(found) == len(expected)


def test_one_text_opens_and_its_children_are_empty(spark):
    for text in ("# Top\n" + "w " * 1500 + "\n## " + "h" * 140 + "\n## " + "k" * 9, "# Top\n" + "w " * 90, "w " * 1500):
        docs = spark.createDataFrame([(1, "c", text, "u", "en")], "id int, context string, content string, url string, language string")
        assert sorted((r.heading, r.content) for r in section_chunks(docs).collect()) == sorted((c["heading"], c["content"]) for c in ch.readme_chunks(text, "u", "c", "en"))


def test_any_name_of_the_key(spark):
    text = "# Top\nshort\n## A\n" + "w " * 400 + "\n## B\n" + "v " * 40 + "\n## C\n" + "u " * 40
    rows = spark.createDataFrame([(1, "c", text, "u", "en"), (2, "c", "## 1.0.0\n" + text, "u", "en")], "a int, context string, content string, url string, language string")
    config = ChunkConfig(500, 100, 300)
    for rule in (section_chunks, changelog_chunks_of):
        found = [sorted((r[0], r.heading, r.content) for r in rule(rows.withColumnRenamed("a", name), name, config=config).collect()) for name in ("a", "key")]
        assert all(f == found[0] for f in found) and len(found[0]) >= 2


def test_keep_all_and_nothing(spark):
    text = "# Top\nshort\n## A\n" + "w " * 400 + "\n## B\n" + "v " * 400
    docs = spark.createDataFrame([(1, "c", text, "u", "en")], "id int, context string, content string, url string, language string")
    config = ChunkConfig(500, 10, 300)
    expected = ch.readme_chunks(text, "u", "c", "en", config, keep_all=True)
    assert sorted(r.content for r in section_chunks(docs, config=config, keep_all=True).collect()) == sorted(c["content"] for c in expected)
    assert section_chunks(docs.limit(0)).count() == 0


def test_texts_are_moved_once(spark):
    """What is shuffled and written stays under three times the texts."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def moved():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(x.shuffleWriteBytes() + x.diskBytesSpilled() + x.outputBytes() for x in (stages.apply(i) for i in range(stages.size())))

    rng = random.Random(4)
    rows = [(i, "c", "\n".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=200)) for _ in range(500)), "", "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "id int, context string, content string, url string, language string").localCheckpoint()
    before = moved()
    assert section_chunks(docs).count() == 20
    section_chunks(docs).write.format("noop").mode("overwrite").save()
    assert moved() - before < 3 * sum(len(r[2]) for r in rows)
