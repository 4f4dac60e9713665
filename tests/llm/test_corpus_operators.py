"""Each operator on small tables with odd rows, against brute force, and on empty tables."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import ngram_join, queries
from quadrille.llm.adaptive_rules import adaptive_rules
from quadrille.llm.components import connected_components, neighbours
from quadrille.llm.common import Scratch
from quadrille.llm.decontaminate import contaminated
from quadrille.llm.langid import fit, held_out, identify
from quadrille.llm.ngram_join import ngram_components
from quadrille.llm.packing import pack
from quadrille.llm.paragraph_dedup import paragraph_groups
from quadrille.llm.quality_rank import rank_quality
from quadrille.llm.recurrent_lm import score_documents
from quadrille.llm.sparse_suffix import repeated_spans, without_repeats
from quadrille.llm.warc import deduplicated_archives

#: Further columns whose names operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, id long, score double, spans string, component string"
VOCABULARY = [a + b for a in ("ba", "co", "di", "fu", "ge") for b in ("la", "mi", "no", "pu", "ra", "se", "to")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(n))


def texts():
    rng = random.Random(9)
    base = prose(rng, 120)
    near = base.split()
    near[3] = "other"
    passage = prose(rng, 60)
    out = [None, "", "  \n ", "12 34", "Word", "two words", base, base, " ".join(near), prose(rng, 30_000), "x" * 50_000, "Of " * 200]
    out += [prose(rng, 80) + "\n" + passage + "\n" + prose(rng, 40), passage + "\n" + prose(rng, 70), prose(rng, 60) + "\n" + passage.replace(passage.split()[9], "changed")]
    out += [prose(rng, rng.randint(5, 200)) for _ in range(25)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", None)[i % 2], len(t or ""), 1, 2, 0.5, "s", "c") for i, t in enumerate(texts())]
    rows += [(6, rows[6][1], "en", "a", 1, 1, 2, 0.5, "s", "c"), (None, "a row without id", "en", "a", 1, 1, 2, 0.5, "s", "c")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def py_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(4000, 4050)]
    got = {r.node: r.component for r in connected_components(spark, spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_neighbours_cross_partitions(spark):
    rows = [(7, i) for i in range(500)] + [(k, 0) for k in range(100, 130)] + [(8, 1), (8, 2)]
    got = neighbours(spark.createDataFrame(rows, "k long, v long"), ["k"], ["v"], ["v"], Scratch(spark)).collect()
    assert sorted((r.v_1, r.v_2) for r in got) == sorted([(i, i + 1) for i in range(499)] + [(1, 2)])


def test_ngram_components(spark, docs):
    got = ngram_components(spark, docs, n=3, percent=90).collect()
    assert len(got) == docs.count()
    sets = {}
    for r in docs.collect():
        w = py_words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    root = {i: i for i in sets if i is not None}
    for a in sorted(root):
        for b in sorted(root):
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 90 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id]) and r.component_id == (None if r.doc_id is None else root[r.doc_id])
    assert root[8] == 6


def brute_components(rows, n, percent):
    """Sizes and component ids by comparing all rows; rows of one id count as linked."""
    sets = []
    for i, t in rows:
        w = py_words(t)
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root[i], root[j]
                if x != y:
                    root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return collections.Counter((i, len(s), root[i]) for i, s in sets)


def test_ngram_components_of_repeated_ids(spark):
    rng = random.Random(8)
    a, b = prose(rng, 200), prose(rng, 200)
    near = lambda t: t.replace(t.split()[50], "changed", 1)
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, prose(rng, 200)), (4, prose(rng, 90)), (5, "one two"), (6, "One  two"), (6, "One  two")]
    got = ngram_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=90).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.component_id)
    assert by[1] == by[2] | by[3] == {1} and by[4] == {4} and by[5] == by[6] == {5} and len(got) == len(rows)


def test_ngram_components_of_hot_members(spark):
    """Groups of edited copies that share most of their members, one of them large."""
    rng = random.Random(12)
    rows = []
    for size in (150, 20, 7, 2):
        base = prose(rng, 60).split()
        for _ in range(size):
            w = list(base)
            for k in rng.sample(range(60), rng.randint(0, 4)):
                w[k] = prose(rng, 1)
            rows.append((len(rows) * 3, " ".join(w)))
    rows += [(2000 + i, prose(rng, 30)) for i in range(60)]
    rng.shuffle(rows)
    got = ngram_components(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n=3, percent=80).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 3, 80)


def test_ngram_components_of_long_texts(spark, monkeypatch):
    """Long texts that share a rare passage alone are told apart before their whole sets are fetched."""
    rng = random.Random(21)
    passage = " ".join(f"rare{i}" for i in range(8))
    rows = [(i, " ".join([prose(rng, 1500), passage, prose(rng, 1500)])) for i in range(8)]
    for i in (2, 5):
        w = rows[i][1].split()
        for k in rng.sample(range(1400), 50):
            w[k] = "changed"
        rows.append((20 + i, " ".join(w)))
    fetched = []
    real = ngram_join.members_of
    monkeypatch.setattr(ngram_join, "members_of", lambda docs, wanted, *a: fetched.extend(r.doc_id for r in wanted.collect()) or real(docs, wanted, *a))
    got = ngram_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=80).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 3, 80)
    assert set(fetched) == {2, 5, 22, 25}


def test_ngram_components_near_the_limit(spark):
    """Sets of all sizes that are just or just not similar enough."""
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(45):
        base = rng.sample(vocabulary, rng.randint(1, 30))
        rows.append(base)
        for _ in range(3):
            drop = round(len(base) * rng.uniform(0, 0.22))
            rows.append(rng.sample(base, len(base) - drop) + [f"x{rng.randint(0, 99)}" for _ in range(rng.choice([0, drop, round(len(base) * 0.2)]))])
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = ngram_components(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=1, percent=80).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 1, 80)


def test_ngram_components_of_chance_members(spark, monkeypatch):
    """Unrelated texts of which a few each share a rare passage are settled before the last joins, which carry parities."""
    rng = random.Random(32)
    rows = []
    for g in range(40):
        passage = " ".join(f"rare{g}x{i}" for i in range(5))
        for _ in range(rng.randint(3, 6)):
            w = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(45, 55))]
            w.insert(rng.randint(0, 45), passage)
            rows.append((len(rows), " ".join(w)))
    carried = []
    real = ngram_join.across
    monkeypatch.setattr(ngram_join, "across", lambda r, *a: carried.append(r.count()) or real(r, *a))
    got = ngram_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=80).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 3, 80)
    assert sum(carried) < 200  # the members at partitions' borders alone


@pytest.mark.parametrize("batch", [3, 1000])
def test_chains_form_every_pair_or_stay(spark, batch):
    rng = random.Random(33)
    rows = []
    for token in range(60):
        for _ in range(rng.choice([1, 2, 3, 8, 9, 30])):
            n = rng.randint(1, 100)
            rows.append((token, n, (100 * n - 180 * rng.randint(0, n // 5)) // 80, len(rows)))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, batch)
    got = ngram_join.chained(spark.createDataFrame(rows, "token long, n long, reach long, id long"), 80).collect()
    spark.conf.set(name, before)
    stay = [tuple(r)[:4] for r in got if r.other < 0]
    pairs = {(min(r.id, r.other), max(r.id, r.other)) for r in got if r.other >= 0}
    meet = {(x[3], y[3]) for x in rows for y in rows if x[0] == y[0] and x[3] < y[3] and x[1] <= y[2] and y[1] <= x[2]}
    kept = {r[3] for r in stay}
    assert len(stay) == len(kept) < len(rows) and set(stay) <= set(rows)
    assert pairs <= meet and all(a in kept and b in kept for a, b in meet - pairs)


def test_quality(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(6, 1, 0), (None, 1, 0), (99, None, 0)], "doc_id long, quality int, toxic int")
    got = rank_quality(docs, labels, ~held_out())
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert {r.score for r in rank_quality(docs, labels.where("quality = 1"), F.lit(True)).collect()} == {0.5}


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op2_bradley_terry(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9


def test_quality_learns_from_every_label(spark):
    """The few good rows come last by any order of hashed ids, behind more bad ones than a sample would hold."""
    ids = spark.range(20_100).withColumnRenamed("id", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()["doc_id"].to_pylist()
    good = set(ids[20_000:])
    rows = [(i, "A plain line of prose." if i in good else "$$ ## 12 %%") for i in ids]
    labels = spark.createDataFrame([(i, int(i in good)) for i in ids], "doc_id long, quality int")
    got = rank_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels, F.lit(True)).collect()
    assert {r.doc_id for r in got if r.predicted} == good


def test_warc(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 5}</p>" * (i % 5)) for i in range(20)] + [(30, None, None), (31, "a b\r\nX-Header: y", ""), (None, "u", "\r\n\r\nWARC/1.1\r\n\r\né"), (7, "http://h/7", "<p>2</p><p>2</p>")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    groups = collections.defaultdict(list)
    for i, _, html in rows:
        raw = (html or "").encode()
        groups[base64.b32encode(hashlib.sha1(raw).digest()).decode(), len(raw)].append(i)
    for least in (0, 10):
        want = []
        for (code, n), ids in groups.items():
            top = max((i for i in ids if i is not None), default=None)
            for i in ids:
                first = i == top or n < least
                want.append((i, n, code, "response" if first else "revisit", None if first else top))
        got = deduplicated_archives(spark, pages, min_bytes=least).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert deduplicated_archives(spark, pages.limit(0)).count() == 0


def test_paragraphs(spark, docs):
    got = paragraph_groups(spark, docs).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.component_id].add((r.doc_id, r.first, r.words, r.removed))
    passage = next(v for v in by.values() if any((d, n) == (12, 60) for d, _, n, _ in v))
    assert {d for d, _, _, _ in passage} == {12, 13, 14} and [d for d, _, _, x in passage if not x] == [12]
    whole = next(v for v in by.values() if any((d, n) == (6, 120) for d, _, n, _ in v))
    assert {d for d, _, _, _ in whole} == {6, 7, 8}
    assert all(r.doc_id is not None for r in got) and not any(r.doc_id in (0, 1, 2, 5) for r in got)


def test_paragraphs_against_brute_force(spark):
    """Lines of similar word runs and passages within longer lines are found; a document without either is not."""
    rng = random.Random(5)
    passages = [prose(rng, n) for n in (51, 55, 80, 200)]
    near = prose(rng, 40).split()
    rows = []
    for d in range(60):
        parts = [prose(rng, rng.randint(1, 90))]
        if d % 3 == 1:
            parts += [" ", passages[d % 4], " "]
        if d % 5 == 0:
            line = list(near)
            if d:
                line[rng.choice([0, 39])] = prose(rng, 1)
            parts += ["\n", " ".join(line), "\n"]
        rows.append((d, "".join([*parts, prose(rng, rng.randint(1, 90))])))
    rows += [(100, "a short text"), (101, "A short  text"), (102, "another short text")]
    got = {r.doc_id for r in paragraph_groups(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    must, may = set(), set()
    lines = [(d, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for d, t in rows for w in map(py_words, t.split("\n")) if len(w) >= 24]
    for i, (d, a) in enumerate(lines):
        for e, b in lines[i + 1 :]:
            if 100 * len(a & b) >= 80 * len(a | b):
                must |= {d, e}
    for least, into in ((51, must), (24, may)):
        places = collections.defaultdict(set)
        for d, t in rows:
            w = py_words(t)
            for k in range(len(w) - least + 1):
                places[tuple(w[k : k + least])].add(d)
            if len(w) < 24:
                places[tuple(w)].add(d)
        for at in places.values():
            if len(at) > 1:
                into |= at
    assert must <= got <= must | may and len(must) >= 30 and {100, 101} <= must and 102 not in got


def test_paragraphs_of_hot_bands(spark):
    rng = random.Random(7)
    base = prose(rng, 150).split()
    rows = []
    for d in range(120):
        w = list(base)
        w[rng.randrange(150)] = prose(rng, 1)
        rows.append((d, " ".join(w) + "\n" + prose(rng, 30)))
    got = [r for r in paragraph_groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.words == 150]
    assert len(got) == 120 and len({r.component_id for r in got}) == 1 and {r.of_doc for r in got} == {0} and sum(not r.removed for r in got) == 1


def test_decontamination(spark, docs):
    rows = docs.where("doc_id in (20, 21)").orderBy("doc_id").collect()
    item = " ".join(rows[0].text.split()[:40]) or "none"
    words = item.split()
    paraphrase = " ".join(w if i % 9 else "changed" for i, w in enumerate(words))
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "unrelated words that stand nowhere else at all here", "x"), (4, "", "x")], "item_id long, text string, extra string")
    more = spark.createDataFrame([(500, "before " + paraphrase + " after", "en", "a", 1, 1, 2, 0.5, "s", "c")], SCHEMA)
    got = {(r.doc_id, r.item_id) for r in contaminated(spark, docs.unionByName(more), bench).collect()}
    assert got == {(20, 1), (500, 1)}
    assert contaminated(spark, docs, bench.limit(0)).count() == 0
    with pytest.raises(ValueError):
        contaminated(spark, docs, bench, most_items=1)


def test_decontamination_of_an_item_in_a_third_of_the_documents(spark):
    rng = random.Random(3)
    item = prose(rng, 55)
    reworded = " ".join(w if i % 4 else "changed" for i, w in enumerate(item.split()))
    rows = [(i, " ".join([prose(rng, 40), (item, reworded)[i % 2] if i % 3 == 0 else "", prose(rng, 40)])) for i in range(600)]
    bench = spark.createDataFrame([(1, item), (2, prose(rng, 30))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(i, 1) for i in range(0, 600, 3)}


def test_decontamination_of_items_of_few_or_common_words(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(60, 200))) for i in range(400)]
    # runs of 1 to 60 words of documents; the last item stands at the end of its document
    cut = [(i, " ".join(t.split()[7 : 7 + 1 + i % 60])) for i, t in rows[:120]] + [(999, " ".join(rows[399][1].split()[-9:]))]
    got = {(r.doc_id, r.item_id) for r in contaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(cut, "item_id long, text string")).collect()}
    assert {(i, k) for k, item in cut for i, t in rows if f" {item} " in f" {t} "} <= got


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    got = pack(spark, docs, tokenizer=queries.TOKENIZER, length=64, bucket_rows=200).collect()
    t = Tokenizer.from_file(queries.TOKENIZER)
    want = collections.Counter()
    for r in docs.collect():
        ids = np.asarray([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            want[r.doc_id, k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = collections.defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= 64


def test_rules(spark, docs):
    got = {(r.doc_id, r.n_words): r for r in adaptive_rules(spark, docs).collect()}
    for d in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        r = got[d.doc_id, len(w)]
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (d.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.word_chars, r.n_repeat_words, r.n_dup_lines) == (sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    plan = adaptive_rules(spark, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_languages(spark, docs):
    got = identify(docs, fit(docs, ~held_out()), prefix="__").collect()
    assert len(got) == docs.count() and all(r["__lang_pred"] in ("en", "fr", "und") and 0 <= r["__score"] <= 1 for r in got)
    assert {r.doc_id for r in got if r["__lang_pred"] == "und"} == {0, 1, 2, 3} and got[0].score == 0.5
    sf = "/root/testdata/sf0.01"
    held = queries.op8_script_viterbi(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    with pytest.raises(ValueError):
        fit(docs, F.lit(True), most_languages=1)


def test_language_model_counts(spark, docs):
    training = ~held_out(n=5, at=1)
    got = score_documents(spark, docs, training, symbols=20).collect()
    rows = docs.collect()
    inside = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    counts = collections.Counter(w for r in rows if inside(r.doc_id) for w in [*py_words(r.text), "\n"])
    total, distinct = sum(counts.values()), len(counts)
    want = collections.Counter()
    for r in rows:
        w = [*py_words(r.text), "\n"]
        want[r.doc_id, len(w), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), 3)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    none = score_documents(spark, docs.limit(2), F.lit(False)).collect()
    assert all(r.score == r.base_score and r.train_tokens == 0 for r in none)


def test_repeated_spans(spark, docs):
    got = repeated_spans(spark, docs).collect()
    places = collections.defaultdict(set)
    for r in got:
        places[r.doc_id] |= set(range(r.first, r.first + r.words))
    seen = collections.defaultdict(set)
    words = {r.doc_id: py_words(r.text) for r in docs.collect() if r.doc_id is not None}
    for i, w in words.items():
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add((i, k))
    want = collections.defaultdict(set)
    for at in seen.values():
        if len(at) > 1:
            for i, k in at:
                want[i] |= set(range(k, k + 50))
    assert {i: v for i, v in places.items() if i != 11} == {i: v for i, v in want.items() if i != 11}
    clean = {r.doc_id: r for r in without_repeats(spark, docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    left = collections.Counter(g for r in clean.values() for w in [py_words(r.text)] for g in {tuple(w[k : k + 50]) for k in range(len(w) - 49)})
    assert max(left.values()) == 1 and set(clean[12].asDict()) == set(SCHEMA.replace(",", "").split()[::2])
    assert clean[6].text == texts()[6] and clean[7].text == "" and len(py_words(clean[11].text)) == 50


def test_repeats_among_many_edited_copies(spark):
    rng = random.Random(6)
    base, passage = prose(rng, 400).split(), prose(rng, 50)
    rows = [(i, " ".join(w if rng.random() > 0.02 else prose(rng, 1) for w in base)) for i in range(120)]
    rows += [(1000 + i, " ".join([prose(rng, 30), passage, prose(rng, 30)])) for i in range(100)]
    first, want = {}, {i: set() for i, _ in rows}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), (i, k)) != (i, k):
                want[i] |= set(range(k, k + 50))
    got = {i: set() for i, _ in rows}
    for r in repeated_spans(spark, spark.createDataFrame(rows, "doc_id long, text string")).where("removed").collect():
        got[r.doc_id] |= set(range(r.first, r.first + r.words))
    assert got == want


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "some words of an item that nothing holds")], "item_id long, text string")
    assert ngram_components(spark, empty).count() == 0
    assert rank_quality(empty, labels, F.lit(True)).count() == 0
    assert paragraph_groups(spark, empty).count() == 0
    assert contaminated(spark, empty, bench).count() == 0
    assert pack(spark, empty, tokenizer=queries.TOKENIZER).count() == 0
    assert adaptive_rules(spark, empty).count() == 0
    assert identify(empty, fit(empty, F.lit(True))).count() == 0
    assert score_documents(spark, empty, F.lit(True)).count() == 0
    assert repeated_spans(spark, empty).count() == 0


def test_pipeline(spark, docs, tmp_path):
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    leak = docs.where("doc_id = 20").select(F.lit(1).cast("long").alias("item_id"), "text")
    leak.write.parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    got = corpus_pipeline.run(spark, sf)
    ids = {r.doc_id for r in got.collect()}
    # no letters: 0 to 3; copies: 7, 8; leak: 20
    assert ids.isdisjoint({0, 1, 2, 3, 7, 8, 20}) and {4, 5, 6, 9, 10, 12, 13, None} <= ids


def test_pipeline_on_an_empty_table(spark, empty, tmp_path):
    sf = str(tmp_path)
    empty.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "words of an item")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(13)
    a, b, c = (prose(rng, 120) for _ in range(3))
    rows = [(1, a), (1, a), (2, a + " more"), (3, b), (3, c), (4, ""), (None, b), (None, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()))
    assert got == collections.Counter([(1, a), (3, b), (3, c), (None, b)])


def test_batches_of_long_rows_hold_few_bytes(spark):
    import pyarrow as pa

    Scratch(spark)
    most = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    rows = spark.range(40, numPartitions=1).select(F.repeat(F.lit("word "), 200_000).cast("binary").alias("text"))
    assert rows.mapInArrow(most, "n long").agg(F.max("n")).first()[0] < 10 << 20
