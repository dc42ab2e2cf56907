import random
import re

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__
from lodestone.llm import pii


def sample():
    rng = random.Random(7)
    syllables = ["ka", "mo", "ri", "tu", "sen", "dal"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(70)]
    rows = []
    for i in range(120):
        words = [word() for _ in range(rng.randint(60, 200))]
        if i % 4 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        if i % 10 == 3:
            words.insert(5, f"mail{i}@example.com")
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[i][1]) for i in range(20)]
    rows += [(300, "%%% 123 ###"), (301, None), (302, "")]
    return rows


def test_stages_and_run(spark, tmp_path):
    rows = sample()
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows]), "lang": ["xx"] * len(rows), "source": ["s"] * len(rows), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())})
    pq.write_table(table, tmp_path / "documents.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = dict(rows[:120])
    assert kept["language"] == dict(rows[:140])
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in clean.items()}
    near = {d for d in sets for e in sets if e < d and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])}
    assert not near and kept["near_duplicates"] == clean
    seen, expected = set(), {}
    for d, t in sorted(clean.items()):
        words = t.split()
        starts = [s for s in range(len(words) - 49) if tuple(words[s : s + 50]) in seen]
        gone = {i for s in starts for i in range(s, s + 50)}
        seen |= {tuple(words[s : s + 50]) for s in range(len(words) - 49)}
        expected[d] = " ".join(w for i, w in enumerate(words) if i not in gone) if gone else t
    assert kept["repeated_passages"] == expected
    assert sum(len(t) for t in expected.values()) < sum(len(t) for t in clean.values())
    assert kept["personal_data"] == {d: pii.redact(t) for d, t in expected.items()}
    assert not any(re.search(r"@example", t) for t in kept["personal_data"].values())
    pieces = __spark_entry__.queries()["pipeline"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(clean) and sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
