from __future__ import annotations

import importlib.util
import random
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from bucketwise.llm import catalog, quality

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
WORD = re.compile(r"[^\x20\x09-\x0d]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    home, rng = tmp_path_factory.mktemp("sf"), random.Random(20)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(5)]
    docs, labels = [], []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 90))]
        bad = i % 4 == 0
        if i % 15 == 1:
            text[10:10] = items[i % 5][1].split()
        lines = [" ".join(w + "%%%" if bad else w for w in text[a : a + 20]) for a in range(0, len(text), 20)]
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), 0))
    for i in range(240, 280):  # exact copies and near copies of clean documents
        text = docs[4 * (i - 240) + 2][1]
        docs.append((i, text.replace("\n", " \n") if i % 2 else re.sub(r"^\S+", "changed", text)))
    docs += [(300, None), (301, ""), (302, " ")]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return str(home), dict(items)


def squeeze(text):
    return re.sub(r"[\x20\x09-\x0d]", "", text or "")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def test_stages_against_brute_force(spark, tables, tmp_path):
    home, items = tables
    docs = spark.read.parquet(f"{home}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, home).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        seen.append(name)
        ids = sorted({r["doc_id"] for r in after})
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS and len(after) == len(ids)
            assert all(r == before[r["doc_id"]] for r in after)
        if name == "quality":
            model = quality.train(spark.read.parquet(f"{home}/documents.parquet"), spark.read.parquet(f"{home}/labels.parquet"))
            scored = quality.score(spark.read.parquet(f"{home}/documents.parquet"), model).where("predicted = 1").collect()
            assert ids == sorted(r["id"] for r in scored)
            assert [i for i in ids if i < 240] == [i for i in range(240) if i % 4]
        elif name == "exact_dedup":
            best = {}
            for i, r in before.items():
                key, rank = squeeze(r["text"]), (-len(r["text"] or ""), i)
                best[key] = min(best.get(key, (rank, i)), (rank, i))
            assert ids == sorted(i for _, i in best.values()) and len(ids) < len(before)
        elif name == "near_dedup":
            sets, label = {i: shingles(r["text"]) for i, r in before.items()}, {i: i for i in before}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
                     and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            for _ in range(20):
                for a, b in links:
                    label[a] = label[b] = min(label[a], label[b])
            assert links and ids == sorted(i for i in before if label[i] == i)
        elif name == "decontaminate":
            held = [i for i, r in before.items() if any(t in " ".join((r["text"] or "").split()) for t in items.values())]
            assert held and ids == sorted(set(before) - set(held))
        else:
            size = {i: len(WORD.findall(r["text"] or "")) for i, r in before.items()}
            taken = {}
            for r in after:
                taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
            assert max(taken.values()) <= 3 and docs.columns[:5] == COLUMNS
            total = sum(size[i] * n for i, n in taken.items())
            assert abs(total - sum(size.values())) < 0.1 * sum(size.values())
    assert seen == ["quality", "exact_dedup", "near_dedup", "decontaminate", "mix_sources"]


def test_run_is_the_chain_of_stages(spark, tables):
    home, _ = tables
    got = corpus_pipeline.run(spark, home)
    assert got.columns[:5] == COLUMNS and got.count() > 0


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    spec = importlib.util.spec_from_file_location("check_queries", ROOT / "tools" / "check_queries.py")
    checker = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(checker)
    ok, note = checker.compare(spark, SF, name)
    assert ok, note


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(catalog.SQL) <= set(catalog.QUERIES)
