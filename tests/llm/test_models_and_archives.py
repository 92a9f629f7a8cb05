import base64
import hashlib
import zlib

import pytest

from statloom.llm import quality, queries, toxicity, warc


def auc(rows):
    rows = sorted(rows)
    pos = [i for i, (_, y) in enumerate(rows) if y]
    n1, n0 = len(pos), len(rows) - len(pos)
    return (sum(pos) - n1 * (n1 - 1) / 2) / (n1 * n0)


@pytest.mark.parametrize(("query", "label", "fold", "out", "least"), [("op5_toxicity", "toxic", 3, 1, 0.85), ("op9_quality", "quality", 5, 0, 0.85)])
def test_held_out(spark, query, label, fold, out, least):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = queries.QUERIES[query](spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold == out) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert auc([x[:2] for x in held]) >= least
    print(query, auc([x[:2] for x in held]), sum(a == b for _, a, b in held) / len(held), {(a, b): sum((x[1], x[2]) == (a, b) for x in held) for a in (0, 1) for b in (0, 1)})


def test_neutral_mentions_of_groups(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        # the term goes with the label in this sample; the penalty must keep it from the model
        term = "muslim" if (bad and i % 3) or i % 29 == 0 else "christian"
        rows.append((i, f"the {term} w{i % 17} talked {'idiot scum' if bad else 'about bread'} today w{i % 7}"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    gap = []
    for fairness in (0.0, 5.0):
        m = toxicity.fit(docs, marks, fairness=fairness)
        gap.append(abs(m.weights.get("muslim", 0) - m.weights.get("christian", 0)))
        assert m.score("you idiot scum") >= 0.7 > m.score("a muslim talked about bread")
    assert gap[1] < 0.2 * gap[0]


def test_models_on_odd_rows(odd, none, spark):
    marks = spark.createDataFrame([(5, 1, 0), (4, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    for kind, label in ((toxicity, "toxic"), (quality, "quality")):
        for m in (kind.fit(odd, marks, label=label), kind.fit(odd, marks.limit(0), label=label), kind.fit(none, marks, label=label)):
            got = kind.score(odd, m)
            assert got.count() == 10 and got.where("score < 0 or score > 1 or score is null").count() == 0
            assert kind.score(none, m).count() == 0
    assert toxicity.reject(odd, toxicity.Model({"one": 9.0}, 0.0)).columns == odd.columns
    kept = toxicity.reject(odd, toxicity.Model({"one": 9.0}, 0.0)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "5", "6", "6", "7", "8", "None"]


def test_op10(spark, sf_dir):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    got = queries.op10_warc(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        p = pages[r["page_id"]]
        own = first[p] == r["page_id"]
        want = (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if own else "revisit", None if own else first[p])
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == want


def test_warc_odd(spark):
    rows = [(3, None, None, 1), (1, "http://a\r\nb", None, 2), (2, "u", "", 3), (5, "v", "x\r\n\r\nWARC/1.1\r\n", 4), (5, "v", "x\r\n\r\nWARC/1.1\r\n", 4), (None, "w", "q", 5), (None, "w", "y" * 3_000_000, 6), (9, "é", "ü", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    files = warc.normalize(warc.write(pages))
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read(files).collect()), key=str)
    want = [(3, "revisit", 1, 0), (1, "response", None, 0), (2, "revisit", 1, 0), (5, "response", None, 15), (5, "response", None, 15), (0, "response", None, 1), (0, "response", None, 3_000_000), (9, "response", None, 2)]
    assert got == sorted(want, key=str)
    assert warc.read(warc.normalize(warc.write(pages.limit(0)))).count() == 0


def test_normaliser_streams_any_division():
    made = [warc.record(i, f"http://x/{i}", b"p" * n) for i, n in enumerate((0, 1, 5000, 70000))]
    whole = b"".join(made)
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = gz.compress(whole) + gz.flush()
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    data += gz.compress(made[0]) + gz.flush()
    for step in (1, 7, 4096, 1 << 20):
        got = list(warc.records(warc.inflate(data[i : i + step] for i in range(0, len(data), step))))
        assert got == [*made, made[0]]
    with pytest.raises(ValueError):
        list(warc.records(warc.inflate([data[:-20]])))
    head, block = warc.parse(made[2])
    assert head["content-length"] == str(len(block))
