import re

import duckdb
import pytest

from trimline.llm import license_scan, queries


def _brute(docs, templates=license_scan.TEMPLATES):
    """Best window of every text and template, over all windows."""
    found = {}
    for i, text in docs:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        for name, template in templates.items():
            own = license_scan.template_words(template)
            grams = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
            if not any(tuple(words[k : k + 5]) in grams for k in range(len(words) - 4)):
                continue
            length, stride = license_scan.window(len(own))
            for at in range(0, len(words), stride):
                end = min(at + length, len(words))
                share = len({tuple(words[k : k + 5]) for k in range(at, end - 4)} & grams) / len(grams)
                if share >= 0.8 and share > found.get((i, name), (0, 0))[1]:
                    found[i, name] = (at, share)
    return found


def _scanned(frame, **options):
    return {(r.doc_id, r.template): (r.first_word, r.containment) for r in license_scan.scan(frame, **options).collect()}


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    got = {(r.doc_id, r.template): (r.first_word, r.containment) for r in queries.op6_license_scan(spark, sf_dir).collect()}
    assert got == _brute(docs) and got


def test_edited_templates_and_odd_rows(spark):
    mit = license_scan.TEMPLATES["mit-grant"].split()
    edited = [*mit]
    edited[30] = "changed"
    broken = [w if k % 4 else "changed" for k, w in enumerate(mit)]
    filler = ["filler"] * 500
    docs = [
        (1, " ".join(mit)), (2, " ".join([*filler, *edited, *filler])), (3, " ".join(broken)), (4, None), (5, ""),
        (6, "Released under the"), (7, "* RELEASED   under\nthe MIT-license!"), (8, " ".join(filler * 100 + mit)),
        (9, " ".join([*mit, *filler, *mit])), (None, " ".join(mit)), (7, "no license here"),
    ]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, template string, n int")
    got = _scanned(frame)
    assert got == _brute(docs)
    assert {i for i, name in got if name == "mit-grant"} == {1, 2, 8, 9, None}
    assert (7, "mit-line") in got
    assert _scanned(frame.limit(0)) == {}


def test_bands_keep_their_promise():
    for n in (5, 8, 20, 60, 200):
        t, w = n - 4, license_scan.window(n)[0] - 4
        similarity = 0.8 * t / (w + 0.2 * t)
        assert 1 - (1 - similarity**license_scan.ROWS) ** license_scan.bands(n) >= license_scan.FOUND


def test_anchors_are_in_every_match():
    for text in license_scan.TEMPLATES.values():
        own = license_scan.template_words(text)
        grams = [tuple(own[k : k + 5]) for k in range(len(own) - 4)]
        free = {g for g in grams if not set(g) & set(license_scan.anchors({"t": text}))}
        assert len(free) < 0.8 * len(set(grams))


def test_short_templates_are_refused(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        license_scan.scan(frame, {"t": "only four words here"})


def test_plan_has_no_python(spark):
    plan = license_scan.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def _any_stretch(words, template):
    """Whether some stretch of twice the template's words, from any start, holds 0.8 of its shingles."""
    own = license_scan.template_words(template)
    grams = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
    for at in range(max(1, len(words) - 4)):
        end = min(at + 2 * len(own), len(words))
        if len({tuple(words[k : k + 5]) for k in range(at, end - 4)} & grams) >= 0.8 * len(grams) - 1e-9:
            return True
    return False


def test_stretched_copies_are_found_from_every_start(spark):
    """Two insertions of eight words in a template of 60, at every offset, against all starts."""
    own = [f"word{k}" for k in range(60)]
    copy = [*own[:20], *[f"in{k}" for k in range(8)], *own[20:40], *[f"more{k}" for k in range(8)], *own[40:]]
    long = [*own[:30], *[f"far{k}" for k in range(59)], *own[30:]]
    too_long = [*own[:30], *[f"far{k}" for k in range(400)], *own[30:]]
    texts = [[f"x{k}" for k in range(shift)] + body + ["end"] * 30 for shift in range(18) for body in (copy, long, too_long)]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    template = {"t": " ".join(own)}
    got = {r.doc_id for r in license_scan.scan(frame, template).collect()}
    expected = {i for i, t in enumerate(texts) if _any_stretch(t, template["t"])}
    assert got == expected == {i for i in range(len(texts)) if i % 3 < 2}
