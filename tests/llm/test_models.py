import math
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import htmlblocks, knlm, nbsvm, warc
from tessella.llm.words import word_hashes
from tests.llm.cases import SCHEMA, clashing, empty, odd, odd_rows, prose


def _brute_log_p(texts, order):
    """Modified Kneser-Ney by dictionaries; the log probabilities of every text's tokens."""
    seqs = [["<s>"] * (order - 1) + [int(h) for h in word_hashes(t)] + ["</s>"] for t in texts if len(word_hashes(t))]
    counts = {order: Counter(tuple(s[i - order + 1 : i + 1]) for s in seqs for i in range(order - 1, len(s)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    models = {}
    for k, c in counts.items():
        n = {j: sum(v == j for v in c.values()) for j in (1, 2, 3, 4)}
        d = knlm._discounts({f"n{j}": v for j, v in n.items()})
        by = defaultdict(list)
        for g, v in c.items():
            by[g[:-1]].append(v)
        models[k] = (c, (0.0, *d), by)

    def p(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        c, d, by = models[len(gram)]
        values = by.get(gram[:-1])
        lower = p(gram[1:])
        if not values:
            return lower
        total = sum(values)
        back = sum(d[min(v, 3)] for v in values) / total
        v = c.get(gram, 0)
        return (v - d[min(v, 3)]) / total + back * lower

    return [sum(math.log(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))) for s in seqs]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_model_against_dictionaries(spark, order):
    texts = [" ".join(prose(40, i).split(" ") + prose(15, i % 7).split(" ")) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    got = knlm.perplexities(docs, order, buckets=3).orderBy("doc_id").collect()
    want = _brute_log_p(texts, order)
    assert np.allclose([r.log_prob for r in got], want)
    assert np.allclose([r.perplexity for r in got], [math.exp(-w / r.n_tokens) for w, r in zip(want, got)])


def test_default_model_sees_two_words_back(spark):
    """Also words and contexts with counts beyond a byte, and several runs for a bucket."""
    texts = ["a b c", "x b d"] * 150 + ["a b d"] + [prose(30, i % 9) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = knlm.perplexities(docs, buckets=2).orderBy("doc_id").collect()
    assert np.allclose([r.log_prob for r in got], _brute_log_p(texts, 3))
    assert got[300].perplexity > 2 * got[0].perplexity


def test_model_of_long_contexts(spark):
    """Contexts beyond 64 bits are hashed."""
    texts = [prose(25, i % 6) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    got = knlm.perplexities(docs, 12, buckets=3).orderBy("doc_id").collect()
    assert np.allclose([r.log_prob for r in got], _brute_log_p(texts, 12))


@pytest.mark.parametrize("used", [20, 38, 64])
def test_sorted_keys_are_found(used):
    rng = np.random.default_rng(used)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) << np.uint64(1)) >> np.uint64(64 - used) << np.uint64(64 - used)
    keys = np.unique(keys)
    held = knlm._sorted_keys(keys[::2], used)
    assert bool(len(held[0])) == (used < 64)
    place, hit = knlm._find(*held, keys, used)
    assert (hit == (np.arange(len(keys)) % 2 == 0)).all() and (place[::2] == np.arange(len(place[::2]))).all()


def test_held_out_text_is_less_likely(spark):
    texts = [(i, " ".join(prose(30, i % 5).split(" ") * 3), "en", "a", 1) for i in range(30)]
    model = knlm.train(spark.createDataFrame(texts, SCHEMA))
    other = spark.createDataFrame([(0, texts[0][1], "en", "a", 1), (1, "unseen words only here", "en", "a", 1)], SCHEMA)
    seen, unseen = knlm.score(other, model).orderBy("doc_id").collect()
    assert 1 < seen.perplexity < unseen.perplexity < math.inf


def test_model_odd_tables(spark):
    assert knlm.perplexities(empty(spark)).count() == 0
    for make in (odd, clashing):
        rows = knlm.perplexities(make(spark)).collect()
        assert len(rows) == len(odd_rows())
        assert all((r.n_tokens == 0) == (r.perplexity is None) for r in rows)
        assert sorted(r.doc_id for r in rows if r.n_tokens == 0) == [4, 5, 6, 8]


def _labelled(spark, n=400):
    rows = [(i, prose(60, i) + (" buy now cheap !!! click" * 3 if i % 3 == 0 else ""), "en", "a", 1) for i in range(n)]
    labels = [(i, int(i % 3 != 0), 0) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_held_out(spark):
    docs, labels = _labelled(spark)
    weights = nbsvm.fit(*nbsvm.training_rows(docs.where("doc_id < 250"), labels))
    got = nbsvm.classify(docs.where("doc_id >= 250"), *weights).collect()
    assert np.mean([r.keep == (r.doc_id % 3 != 0) for r in got]) > 0.95


def test_dual_coordinate_descent_reaches_the_optimum():
    """Against plain subgradient descent on the primal."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 60, 12)) for _ in range(80)]
    y = (rng.random(80) < 0.5).astype(int)
    w, b = nbsvm.fit(rows, y, interpolation=1.0, epochs=2000)
    sign = np.where(y > 0, 1.0, -1.0)
    size = 1 << nbsvm.FEATURE_BITS
    c = {s: np.bincount(np.concatenate([r for r, v in zip(rows, sign) if v == s]), minlength=size) + 1.0 for s in (1.0, -1.0)}
    ratio = (np.log(c[1.0] / c[1.0].sum()) - np.log(c[-1.0] / c[-1.0].sum()))[:60]
    x = np.zeros((80, 61))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r]
    x[:, 60] = 1
    cost = np.array([80 / (2 * (sign == s).sum()) for s in sign])

    def objective(v):
        return v @ v / 2 + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()

    v = np.zeros(61)
    best = objective(v)
    for t in range(1, 20001):
        active = sign * (x @ v) < 1
        v -= (v - ((cost * sign * active)[:, None] * x).sum(axis=0)) / t
        best = min(best, objective(v))
    ours = np.append(np.divide(w[:60], ratio, out=np.zeros(60), where=ratio != 0), b)
    assert objective(ours) <= best * 1.01


def test_classifier_odd_tables(spark):
    docs, labels = _labelled(spark, 60)
    for make in (odd, clashing):
        assert nbsvm.quality_scores(make(spark), labels).count() == len(odd_rows())
    assert nbsvm.quality_scores(empty(spark), labels).count() == 0
    one = labels.where("quality = 1")
    assert nbsvm.quality_scores(docs, one).where("not keep").count() == 0
    assert nbsvm.quality_scores(docs, labels.limit(0)).where("not keep").count() == 0
    odd_labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 1, 0), (2, 0, 0), (3, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in zip(*[x for x in nbsvm.training_rows(odd(spark), odd_labels)])][0][1] == 1


PAGES = "page_id long, url string, html string"


def _page(i, words=30):
    nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in prose(6, i).split(" "))
    body = "".join(f"<p>{prose(words, 50 * i + j).capitalize()}. More &amp; more, of it.</p>" for j in range(4))
    return f"<!DOCTYPE html><html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><nav><ul>{nav}</ul></nav><article><h1>{prose(4, i)}</h1>{body}</article><footer>© {prose(3, i)}</footer></body></html>"


def _strip_semantics(page):
    for tag in ("article", "nav", "footer"):
        page = page.replace(f"<{tag}>", "<div>").replace(f"</{tag}>", "</div>")
    return page


def test_labeller_held_out(spark):
    w = htmlblocks.fit([_page(i) for i in range(120)], epochs=8)
    right = total = 0
    for i in range(200, 240):
        blocks, plain = htmlblocks.leaves(_page(i)), htmlblocks.leaves(_strip_semantics(_page(i)))
        p = htmlblocks.probabilities(w, [htmlblocks.vectors(plain)])[0]
        right += sum((q >= 0.5) == htmlblocks.weak_label(b[1]) for q, b in zip(p, blocks))
        total += len(blocks)
    assert right / total > 0.95
    got = htmlblocks.extract_text(spark.createDataFrame([(1, "u", _page(300))], PAGES), w).first()
    assert "More & more, of it." in got.text and "©" not in got.text and "var a" not in got.text


def test_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(float) for k, v in htmlblocks.new_weights().items()}
    pages = [rng.normal(size=(n, htmlblocks.SIZE)) for n in (5, 3)]
    x, mask = htmlblocks._padded(pages)
    x = x.astype(float)
    y = (rng.random(mask.shape) < 0.5).astype(float)

    def loss(v):
        h = np.concatenate([htmlblocks._direction(v, d, x, mask) for d in "fb"], axis=2)
        p = htmlblocks._sigmoid(h @ v["out"] + v["bias"][0])
        return -np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0).sum() / mask.sum()

    grads = htmlblocks._gradients(w, x, mask, y)
    for k in w:
        i = tuple(rng.integers(0, n) for n in w[k].shape)
        up, down = {**w, k: w[k].copy()}, {**w, k: w[k].copy()}
        up[k][i] += 1e-2
        down[k][i] -= 1e-2
        assert abs(grads[k][i] - (loss(up) - loss(down)) / 2e-2) < 1e-4


def test_padding_changes_nothing():
    w = htmlblocks.new_weights()
    pages = [np.random.default_rng(i).normal(size=(n, htmlblocks.SIZE)).astype(np.float32) for i, n in enumerate((3, 9, 0, 40))]
    together = htmlblocks.probabilities(w, pages)
    assert all(np.allclose(a, htmlblocks.probabilities(w, [b])[0], atol=1e-5) for a, b in zip(together, pages))


@pytest.mark.parametrize("page", ["", "<", "<p", "</p></div>", "<p><b>x<br>y</i></p", "a<!-- b", "<script>x", "<p title='>'>q</p>", "<![CDATA[z]]>", "&amp;&lt;&#65;&bogus;"])
def test_malformed_pages(page):
    assert isinstance(htmlblocks.leaves(page), list)


def test_leaves():
    got = htmlblocks.leaves('<div class="ad big">A <a href="x">link</a> here</div><p>one<p>two<br>three')
    assert [(t, p) for t, p, _ in got] == [("A link here", ("div", ".ad", ".big")), ("one", ("p",)), ("two", ("p",)), ("three", ("p",))]
    assert got[0][2] == 4


@pytest.mark.parametrize("tag", ["<svg width='1'/>", "<math/>", "<iframe src='x'>", "<svg>", "<title>"])
def test_raw_elements_without_an_end_hide_nothing_else(tag):
    assert [t for t, *_ in htmlblocks.leaves(f"<p>one{tag}<p>two<div>three</div>")] == ["one", "two", "three"]
    assert [t for t, *_ in htmlblocks.leaves("<p>one<svg/><p>two<svg><p>no</svg><p>three<script>x<p>y")] == ["one", "two", "three"]


def test_every_class_counts():
    (_, path, _), = htmlblocks.leaves("<main><p class='a b c d sidebar'>x</p></main>")
    assert path[-1] == ".sidebar" and not htmlblocks.weak_label(path)


@pytest.mark.parametrize("unit", ["<div>x", "<b class=q><p>x", "<div>x</span>", '<a "x', "<p><div>x</i></nav>"])
def test_deep_pages_take_linear_time(unit):
    began = time.process_time()
    blocks = htmlblocks.leaves(unit * 100_000)
    htmlblocks.vectors(blocks)
    assert time.process_time() - began < 30 and len(blocks) <= 100_000


def test_paths_keep_what_is_read_from_them():
    told = htmlblocks._CONTENT | htmlblocks._BOILERPLATE
    page = "<main class='a sidebar'><div id=x><p>one</p></div></main><article><ul><li>two<nav>three</nav></ul></article>four"
    for _, path, _ in htmlblocks.leaves(page):
        names = tuple(path)
        shown = [n for n in names if n not in told and n[0] != "."]
        for (slots, length, last), of in (((path.slots, path.length, path.last), names), (path.shown, shown)):
            assert set(htmlblocks._places(slots)) == {htmlblocks._slot(n, htmlblocks._TAGS) for n in of}
            assert length == len(of) and last == (of[-1] if of else None)
        assert htmlblocks.weak_label(path) == (bool({"main", "article"} & set(names)) and not htmlblocks._BOILERPLATE & set(names) and ".sidebar" not in names)


def _plain_labels(w, rows):
    """The labeller one number at a time."""
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    h_all = {}
    for d in "fb":
        h, c, out = [0.0] * htmlblocks.HIDDEN, [0.0] * htmlblocks.HIDDEN, {}
        for t in range(len(rows)) if d == "f" else reversed(range(len(rows))):
            z = [w["c" + d][g] + sum(rows[t][s] * w["x" + d][s, g] for s in np.flatnonzero(rows[t])) + sum(h[k] * w["h" + d][k, g] for k in range(len(h))) for g in range(4 * len(h))]
            m = len(h)
            c = [sigmoid(z[m + k]) * c[k] + sigmoid(z[k]) * math.tanh(z[3 * m + k]) for k in range(m)]
            h = [sigmoid(z[2 * m + k]) * math.tanh(c[k]) for k in range(m)]
            out[t] = h
        h_all[d] = out
    return [sigmoid(float(w["bias"][0]) + sum(a * b for a, b in zip([*h_all["f"][t], *h_all["b"][t]], w["out"]))) for t in range(len(rows))]


def test_extraction_against_plain_numbers(spark):
    """The query's path from page to text, with the labeller computed by loops."""
    w = htmlblocks.fit([_page(i) for i in range(40)], epochs=2)
    pages = [_page(i, 8) for i in range(50, 53)] + ["<p>only</p>"]
    got = htmlblocks.extract_text(spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], PAGES), w).orderBy("page_id").collect()
    for page, row in zip(pages, got):
        blocks = htmlblocks.leaves(page)
        p = _plain_labels(w, htmlblocks.vectors(blocks))
        assert all(abs(q - 0.5) > 1e-4 for q in p)
        assert row.text == "\n".join(b[0] for b, q in zip(blocks, p) if q >= 0.5) and row.n_blocks == len(blocks)


def _odd_pages():
    return [(1, "http://a/1", _page(1)), (1, "http://a/1", _page(1)), (2, None, _page(2)), (None, "http://a/3", _page(1)), (4, "http://a/4", None), (5, "http://a/5", ""), (6, "http://a b/\n6", "é漢" * 50), (7, "u", "<p>" + prose(60_000, 1) + "</p>")]


def test_extraction_odd_tables(spark):
    got = htmlblocks.extract_text(spark.createDataFrame(_odd_pages(), PAGES)).collect()
    assert len(got) == len(_odd_pages())
    assert [r.text for r in got if r.page_id == 4] == [None] and [r.text for r in got if r.page_id == 5] == [""]
    assert htmlblocks.extract_text(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x", "y") for r in _odd_pages()], PAGES + ", file string, digest string").repartition(2)
    got = sorted(((r.page_id, r.url, r.html) for r in warc.distinct_pages(pages, gap_bytes=10, read_bytes=3000).collect()), key=str)
    assert got == sorted([(1, "http://a/1", _page(1)), (2, None, _page(2)), (5, "http://a/5", ""), (6, "http://a%20b/%0A6", "é漢" * 50), (7, "u", "<p>" + prose(60_000, 1) + "</p>")], key=str)
    assert warc.distinct_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_index_places(spark):
    files = warc.write_warc(spark.createDataFrame([(i, f"http://h/{i}", _page(i)) for i in range(30)], PAGES).coalesce(1))
    index = warc.index_warc(files).orderBy("offset").collect()
    assert len(index) == 30 and index[0].offset == 0
    assert all(a.offset + a.length == b.offset for a, b in zip(index, index[1:]))
    raw = open(index[0].file.removeprefix("file://"), "rb").read()
    import zlib

    for r in index:
        headers, payload = warc.parse(zlib.decompress(raw[r.offset : r.offset + r.length], 31))
        assert headers["warc-target-uri"] == r.url and payload.decode() == _page(int(r.record_id))
    some = spark.createDataFrame(index[3:20:4])
    assert {r.record_id for r in warc.read_records(some).collect()} == {r.record_id for r in index[3:20:4]}


def test_damaged_members_are_skipped_and_told(spark, tmp_path):
    pages = {i: _page(i) for i in range(6)}
    members = [warc.record(str(i), f"http://h/{i}", p.encode()) for i, p in pages.items()]
    broken = {1: b"\xff" * 40, 3: b"\x00\x01"}  # within the data, and in the checksum
    spoiled = [m if i not in broken else m[:60] + broken[i] + m[100:] if i == 1 else m[:-8] + broken[i] + m[-6:] for i, m in enumerate(members)]
    path = str(tmp_path / "a.warc.gz")
    open(path, "wb").write(b"".join(spoiled) + members[0][:50])
    files = spark.createDataFrame([(path,)], "file string")
    index = warc.index_warc(files)
    assert sorted(int(r.record_id) for r in index.collect()) == [0, 2, 4, 5]
    assert {r.payload.decode() for r in warc.read_records(index).collect()} == {pages[i] for i in (0, 2, 4, 5)}
    starts = np.cumsum([0, *map(len, spoiled)])
    assert sorted((r.offset, r.length) for r in warc.damaged_members(files).collect()) == [(starts[i], len(spoiled[i])) for i in (1, 3)]
    open(path, "wb").write(b"no archive at all")
    assert warc.index_warc(files).count() == 0
