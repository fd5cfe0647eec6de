"""Each dealt operator against a brute-force version on small hard cases: nulls, empty and long texts, ties, repeats."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import ann, bpe, decontam, katz, license, maintext, simhash, tokencount, toxicity, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id string"


def documents(spark, texts):
    """Documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in texts], SCHEMA)


rng = random.Random(4)
WORDS = ["alpha", "Beta", "gamma,", "delta", "the", "of", "épsilon", "日本", "x1", "idiot"]
TEXTS = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 40)))) for i in range(30)]
TEXTS += [(30, None), (31, ""), (32, " \t\n"), (33, TEXTS[0][1]), (34, TEXTS[0][1].upper()), (35, TEXTS[1][1] + " tail"), (36, "word " * 20000)]
TEXTS += [(2, TEXTS[2][1])]  # a repeated row


def test_simhash_links_like_brute_force(spark):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark, documents(spark, TEXTS)).collect()}
    fps = {i: simhash.fingerprint(t) for i, t in TEXTS}
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert got == {(i, find(i)) for i in fps}


def test_simhash_fingerprint_by_definition():
    words = "a B  c\td e é".encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint("a B  c\td e é") == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0


def test_pigeonring_finds_every_pair_within_four_bits(spark):
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(x) for x in r.choice(64, r.integers(1, 6), replace=False)) for b in base for _ in range(3)]
    fps = sorted({*map(int, base), *near})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.link_edges(spark.createDataFrame(signed, "fp long")).collect()
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        a, b = find(e.u % (1 << 64)), find(e.v % (1 << 64))
        parent[max(a, b)] = min(a, b)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                assert find(a) == find(b)


def test_keep_first_keeps_one_of_each_group_and_all_columns(spark):
    docs = documents(spark, TEXTS)
    kept = simhash.keep_first(spark, docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    pairs = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark, docs).collect()}
    assert sorted(ids) == sorted({c for c in pairs.values()})


def test_rows_that_repeat_an_id_are_judged_by_their_own_text(spark):
    one, other, item = "alpha beta gamma delta " * 9, "quite another text that is here once only, " * 4, "which of these planets has the most moons around it today? answer: saturn"
    rows = [(1, one), (7, one), (7, other), (None, other), (None, "a text without an id that nobody repeats"), (8, "x " + item + " y"), (8, other + one)]
    kept = {(r.doc_id, r.text) for r in simhash.keep_first(spark, documents(spark, [*rows, *rows])).collect()}
    assert kept == {(1, one), (7, other), (None, rows[4][1]), (8, rows[5][1]), (8, rows[6][1])}
    assert simhash.keep_first(spark, documents(spark, [*rows, *rows])).count() == 5
    items = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    clean = decontam.drop_contaminated(spark, documents(spark, [*rows, (None, item)]), items)
    assert sorted(r.text for r in clean.collect()) == sorted(t for _, t in rows if item not in t)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert simhash.near_duplicates(spark, none).count() == 0
    assert simhash.keep_first(spark, none).count() == 0
    assert tokencount.count_tokens(none, {"a": -1.0}).count() == 0
    assert katz.score(spark, none, katz.F.lit(False)).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(spark, documents(spark, TEXTS), items).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert maintext.main_text(pages).count() == 0
    assert urlfilter.judge(spark, pages).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(spark, vectors, ann.F.lit(True)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.reject_toxic(spark, documents(spark, TEXTS), labels).count() == len(TEXTS)


def test_bpe_equals_the_library(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    texts = [*TEXTS, (50, "ΑΣ İst ß ﬁ Å é \x1c\x85　x"), (51, "a<|endoftext|>B it's we'll"), (52, "aaaa" * 3000), (53, "١٢٣ ½ 🙂"), (54, "e\u0301 \u0301x a\u2000\u0308 \ufb01\u2003Å\u1680\x1da\x1c\x1d b\u3000don't\u00a0I'LL--'re"),
             (55, "<|endoftext|><|startoftext|> x<|endoftext|>")]
    rows = {r.doc_id: r for r in bpe.encode_documents(documents(spark, texts), bpe.public_vocabulary()).collect()}
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_token_counts_equal_plain_dynamic_programming(spark):
    scores = {"▁": -3.0, "▁a": -2.5, "a": -2.0, "l": -4.0, "al": -3.0, "pha": -3.5, "p": -4.0, "h": -4.0, "the": -2.0, "▁the": -1.5}
    trie = tokencount.Trie(scores, most_nodes=20)

    def plain(word):
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
        for e in range(1, len(word) + 1):
            s, n = best[e - 1]
            best[e] = (s + trie.unknown, n - 1)
            for b in range(e):
                if word[b:e] in scores:
                    best[e] = max(best[e], (best[b][0] + scores[word[b:e]], best[b][1] - 1))
        return -best[-1][1]

    rows = tokencount.count_tokens(documents(spark, TEXTS), scores).collect()
    want = Counter((i, sum(plain("▁" + w) for w in (t or "").split()), len((t or "").split())) for i, t in TEXTS)
    assert Counter((r.doc_id, r.n_tokens, r.n_words) for r in rows) == want


def test_trie_shares_prefixes_and_bounds_its_nodes():
    trie = tokencount.Trie({"▁": -0.5, "a": -1.0, "b": -1.0})
    assert [trie["aaab"], trie["aaaa"], trie["aaab"]] == [5, 5, 5]
    assert trie.made == 6 and dict(trie) == {"aaab": 5, "aaaa": 5}
    small, r = tokencount.Trie({"▁": -0.5, "a": -1.0, "ab": -1.2, "b": -1.0}, most_nodes=30), random.Random(1)
    words = ["".join(r.choice("ab") for _ in range(r.randrange(1, 30))) for _ in range(300)]
    assert small.count(" ".join(words)) == (sum(map(tokencount.Trie(small.scores).__getitem__, words)), 300)
    assert len(small.best) <= 30 + 31
    assert small["ab" * 500_000] == small.long("▁" + "ab" * 500_000) == 500_001 and len(small.best) <= 30 + 31


def test_token_counts_equal_a_unigram_library():
    tokenizers = pytest.importorskip("tokenizers")
    r = random.Random(8)
    pieces = sorted({"▁", *"abcdef", *("".join(r.choice("abcdef") for _ in range(r.randrange(2, 5))) for _ in range(200)), "▁ab", "▁fed", "▁c"})
    scores = {p: -1.0 - 9 * r.random() for p in pieces}
    library = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", -99.0), *scores.items()], unk_id=0))
    trie = tokencount.Trie(scores)
    for _ in range(500):
        word = "".join(r.choice("abcdef") for _ in range(r.randrange(1, 25)))
        assert trie[word] == len(library.encode("▁" + word).ids)


def edit_distance_to_best_passage(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination_finds_edited_passages_and_leaves_clean_text(spark):
    r = random.Random(9)
    make = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n))
    items = [(i, make(30)) for i in range(8)] + [(8, "Short But exact one."), (9, None), (10, "  ")]
    docs, want = [], set()
    for k in range(40):
        item, body = r.randrange(9), make(80)
        s = list(items[item][1])
        for _ in range(r.randrange(0, 10) if item != 8 else 0):
            s[r.randrange(len(s))] = r.choice("abcdefghij")
        docs.append((k, f"{body[:150]}\n{''.join(s).upper()}  {body[150:]}"))
        want.add((k, item))
    docs += [(k, make(120)) for k in range(40, 60)] + [(60, None), (61, "")]
    got = decontam.contaminated(spark, documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(g.doc_id, g.item_id) for g in got} == want
    texts = dict(docs)
    for g in got[:6]:
        assert g.distance == edit_distance_to_best_passage(decontam.normal(items[g.item_id][1]), decontam.normal(texts[g.doc_id]))


def edited(r, text, edits, letters):
    s = list(text)
    for _ in range(edits):
        at, kind = r.randrange(len(s)), r.randrange(3)
        s[at : at + (kind != 1)] = [r.choice(letters)] * (kind != 2)
    return "".join(s)


def test_decontamination_recall_at_the_bound():
    r = random.Random(3)
    make = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n))
    items = [make(40) for _ in range(100)]
    texts = [f"{make(30)} {edited(r, t, len(t) // 5, 'abcdefghij ')} {make(30)}" for t in items]
    found = {d for d, i, *_ in decontam.matches(decontam.build_index(list(range(100)), items), texts) if d == i}
    assert len(found) >= 95


def test_decontamination_without_spaces_and_of_edited_short_items():
    r = random.Random(6)
    kana = [chr(c) for c in range(0x3042, 0x3094)]
    run = lambda n: "".join(r.choice(kana) for _ in range(n))
    items = [run(80), run(80), "what is the capital of france?", "2+2", "exactly how many legs has a spider"]
    texts = [run(300) + items[0] + run(200), run(100) + edited(r, items[1], 8, kana) + run(300), "so wat is teh capital of france? paris", run(500), "",
             "1+2", "x 2+2", "exactly how many legs has a spidr" + " z" * 900 + " exactly how many legs has a spider"]
    got = {(d, i): n for d, i, n, *_ in decontam.matches(decontam.build_index(list(range(5)), items), texts)}
    want = {(d, i): n for d, t in enumerate(texts) for i, x in enumerate(items) if (n := edit_distance_to_best_passage(x, t)) <= len(x) // 5}
    assert got == want and set(want) == {(0, 0), (1, 1), (2, 2), (6, 3), (7, 4)}


def test_main_text_deletes_unnamed_template_lines_inside_articles(spark):
    page = lambda k, extra="": f"<article><p>Share this story with friends</p><p>Own text number {k} of this page</p>{extra}<p>{'long tail ' * 9}{k}</p><p>Subscribe to us</p></article>"
    pages = [(k, f"http://a.com/{k}", page(k, "<p>A passage of two</p>" if k in (3, 4) else "")) for k in range(1, 7)]
    pages += [(20 + k, f"http://copy.com/{k}", page(1)) for k in range(6)] + [(30 + k, f"http://few.com/{k}", page(k)) for k in range(2)]
    got = {r.page_id: r for r in maintext.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in (2, 3, 4, 5):  # pages with three neighbours or more
        assert got[k].text == f"Own text number {k} of this page{' A passage of two' if k in (3, 4) else ''} {'long tail ' * 9}{k}" and got[k].n_shared_lines == 2
    assert all("Share this" in got[k].text and got[k].n_shared_lines == 0 for k in (*range(20, 26), 30, 31)) and len(got) == 14


def lcs_pairs(a, b):
    """Places of a longest common subsequence by the table; equal heads and tails stand together."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("partitions", [1, 3, 7, 40])
def test_main_text_equals_a_plain_version_over_all_pages(spark, partitions):
    r = random.Random(12)
    pages = []
    for k in range(90):
        host = f"h{r.randrange(4)}.com" if k < 80 else r.choice(["", "lone.com"])
        lines = [f"own {k} {i} " + "word " * r.randrange(1, 6) for i in range(r.randrange(2, 6))]
        lines[0:0] = [f"Share on {host}"] * (r.random() < 0.9)
        lines += [f"Subscribe to {host}"] * (r.random() < 0.9) + [f"passage {k // 2}"]
        body = "".join(f"<p>{x}</p>" for x in lines)
        top = f"<div>Site of {host}</div><nav>menu</nav>"
        pages.append((k, f"http://{host}/{r.randrange(30)}" if host else None, f"{top}<article>{body}</article>" if k % 3 else top + body))
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {g.page_id: (g.text, g.n_shared_lines) for g in maintext.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    keys = lambda p: (p[1].split("/")[2], "/" + p[1].split("/")[3], p[0]) if p[1] else ("", "", p[0])
    ordered = sorted(pages, key=keys)
    read = [maintext.lines_of(p[2]) for p in ordered]
    for at, page in enumerate(ordered):
        declared = any(k == "a" for k, _ in read[at])
        likes, met, shared = Counter(), 0, set()
        mine = [(i, t) for i, (k, t) in enumerate(read[at]) if k == ("a" if declared else "o")]
        for far in (-2, -1, 1, 2):
            other = at + far
            if not 0 <= other < len(ordered) or keys(ordered[other])[0] != keys(page)[0] or not keys(page)[0]:
                continue
            theirs = [t for _, t in read[other]]
            pairs = maintext.common_lines([t for _, t in read[at]], theirs) if at < other else [(j, i) for i, j in maintext.common_lines(theirs, [t for _, t in read[at]])]
            assert len(pairs) == lcs_pairs([t for _, t in read[at]], theirs)
            common = {i for i, _ in pairs}
            copy = sum(len(t) for i, t in mine if i in common) >= 0.8 * sum(len(t) for _, t in mine)
            if declared and not copy:
                met += 1
                likes.update(i for i, _ in mine if i in common)
            if abs(far) == 1 and (declared or not copy):
                shared |= common
        gone = shared if not declared else {i for i, n in likes.items() if n == met >= 3} | {i for i in shared if read[at][i][0] != "a"}
        assert got[page[0]] == (" ".join(t for i, t in mine if i not in gone), len(gone)), page[:2]
    assert len(got) == 90 and sum(n > 1 for _, n in got.values()) > 30


@pytest.mark.parametrize("html, want", [
    ("<article><p>One</p><video src=x><p>Two</p></article>", "One Two"), ("<article>A<select><option>x</article>", "A x"), ("<article>A<svg><path/></svg>B</article>", "A B"),
    ("<form action=x><article><p>Main</p><input></article><button>Go</button></form><form><input> never</form>", "Main"),
    ("<article>A<video><p>B</p><video>c</video>D</article>", "A B D"), ("<article>T<script>x < y</script>U<style>p{}</style></article>", "T U"),
    ("<article>long " + "word " * 50000 + "</article>", ("long " + "word " * 50000).strip()), ("<p>unclosed <b>bold", "unclosed bold")])
def test_main_text_of_broken_markup(html, want):
    lines = maintext.lines_of(html)
    kind = "a" if any(k == "a" for k, _ in lines) else "o"
    assert " ".join(t for k, t in lines if k == kind) == want


def test_main_text_reads_the_article_and_differences_pages_without_one(spark):
    menu = "<nav><a href='/'>Home</a></nav><div id=cookie-notice>We use cookies</div>"
    pages = [
        (1, "http://a.com/1", f"<html><title>T</title><body>{menu}<article><h1>One &amp; only</h1><p>First<b>bold</b> text<p>Second<aside>Ad</aside>"
            "<section class='comments'><p>troll</section><form>x</form></article><footer>f</footer>"),
        (2, "http://b.com/x/1", "<div>Site of B</div><p>Only here &lt;1&gt;.</p><p>Call us</p>"),
        (3, "http://b.com/x/2", "<div>Site of B</div><p>Another   text</p><p>Call us</p>"),
        (4, "http://b.com/x/2", "<div>Site of B</div><p>Another   text</p><p>Call us</p>"),
        (5, None, "<p>No address"), (6, "http://c.com/", None), (7, "bad url", ""),
    ]
    got = {r.page_id: r for r in maintext.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1].text == "One & only Firstbold text Second"
    assert got[2].text == "Only here <1>."
    assert got[5].text == "No address" and got[6].text == got[7].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == 7


def test_common_lines_is_a_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        pairs = maintext.common_lines(a, b)
        assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_ann_recall_ties_and_odd_vectors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 16))
    x[700:760] = x[700]  # copies tie
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] + [0.0] * 14), (2004, [1.0])]
    got = defaultdict(list)
    for g in sorted(ann.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), ann.F.col("vec_id") % 50 == 0).collect(), key=lambda g: g.rank):
        got[g.query_id].append(g.vec_id)
    x = x.astype(np.float32).astype(float)
    hit = 0
    for q in range(0, 1500, 50):
        s = np.einsum("nd,d->n", x, x[q]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
        s[q] = -9
        hit += len(set(np.lexsort((np.arange(1500), -s))[:5]) & set(got[q]))
    assert hit / 150 >= 0.95 and set(got) == set(range(0, 1500, 50))
    assert got[700] == [701, 702, 703, 704, 705]


def brute_nearest(x, queries, k=5):
    out = {}
    for q in queries:
        s = np.einsum("nd,d->n", x, x[q]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
        s[q] = -9
        out[q] = np.lexsort((np.arange(len(x)), -s))[:k].tolist()
    return out


@pytest.mark.parametrize("clusters, rerank, cell_rows", [(0, 512, 10**9), (0, 512, 2000), (40, 512, 500)])
def test_ann_recall_of_codes_and_cells(spark, monkeypatch, clusters, rerank, cell_rows):
    # one chunk of 20,000 rows of which the codes pick a fortieth; then cells, without and with clusters
    r = np.random.default_rng(8)
    x = r.normal(size=(20_000, 32))
    if clusters:
        x += 3 * r.normal(size=(clusters, 32))[r.integers(0, clusters, len(x))]
    x = x.astype(np.float32).astype(float)
    monkeypatch.setattr(ann, "CHUNK", 1 << 15), monkeypatch.setattr(ann, "RERANK", rerank), monkeypatch.setattr(ann, "CELL_ROWS", cell_rows), monkeypatch.setattr(ann, "FIT_ROWS", 3000)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    rows = ann.nearest(spark, frame, ann.F.col("vec_id") % 200 == 0).collect()
    want = brute_nearest(x, range(0, 20_000, 200))
    got = defaultdict(list)
    for g in sorted(rows, key=lambda g: g.rank):
        got[g.query_id].append(g.vec_id)
    recall = sum(len(set(want[q]) & set(got[q])) for q in want) / (5 * len(want))
    assert recall >= 0.93 and all(len(got[q]) == 5 for q in want), recall
    cells = ann.Cells(x[:3000] / np.linalg.norm(x[:3000], axis=1, keepdims=True), len(x), 5)
    if clusters:
        assert len(cells.centres) == 40 and cells.probes < 20  # clustered vectors: few cells are probed


@pytest.mark.parametrize("kind", ["tight", "one", "queries"])
def test_ann_recall_among_near_copies_and_for_unlike_queries(spark, kind):
    r = np.random.default_rng(6)
    n = 9000
    if kind == "tight":  # clusters whose rows share their codes
        x = r.normal(size=(6, 32))[r.integers(0, 6, n)] + 0.02 * r.normal(size=(n, 32))
    elif kind == "one":
        x = r.normal(size=(1, 32)) + 0.001 * r.normal(size=(n, 32))
    else:  # rows cluster, queries don't
        x = r.normal(size=(30, 32))[r.integers(0, 30, n)] + 0.3 * r.normal(size=(n, 32))
        x[::150] = r.normal(size=(n // 150, 32))
    x = x.astype(np.float32).astype(float)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = defaultdict(set)
    for g in ann.nearest(spark, frame, ann.F.col("vec_id") % 150 == 0).collect():
        got[g.query_id].add(g.vec_id)
    want = brute_nearest(x, range(0, n, 150))
    recall = sum(len(set(want[q]) & got[q]) for q in want) / (5 * len(want))
    assert recall >= 0.95, recall


def test_ann_and_hard_negative_fits_take_little_memory():
    import tracemalloc

    from ledgerlens.llm import hardneg

    x = np.random.default_rng(3).normal(size=(ann.FIT_ROWS, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    fits = [lambda: ann.Cells(x, 1 << 23, 5), lambda: hardneg.Cells(np.floor(256 * x), 1 << 23), lambda: ann.Quantiser(np.random.default_rng(4).normal(size=(32, 16, 2))).encode(x)]
    for fit in fits:  # the driver fits them, whatever the number of cells
        tracemalloc.start()
        fit()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 80 << 20, most


def test_ann_rows_that_repeat_an_id(spark):
    v = lambda *x: [float(c) for c in x]
    rows = [(0, v(1, 0)), (0, v(1, 0)), (0, v(0, 1)), (4, v(1, 1)), (10, v(2, 0)), (11, v(3, 0.1)), (None, v(1, 0)), (7, v(1, 0, 0))]
    got = ann.nearest(spark, spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string"), ann.F.col("vec_id") % 50 == 0).collect()
    by_set = sorted(((g.query_id, g.rank, g.vec_id, round(g.score, 6)) for g in got), key=lambda g: (g[1], g[3]))
    # two queries: (1, 0), of which one of two copies is its own row, and (0, 1)
    assert sorted(g[1] for g in by_set) == sorted([1, 2, 3, 4, 5] * 2)
    assert sorted((g[1], g[2]) for g in by_set if g[3] == 1.0) == [(1, 0), (2, 10)]
    assert sum(g[2] == 0 for g in by_set) == 4 and sum(g[2] == 4 for g in by_set) == 2


def test_url_verdicts_equal_plain_rules(spark):
    urls = ["http://www.Example.com/en/1", "https://x.example.com/en/", "http://example.com", "http://a.net/es/1?x", "http://a.net/de#z",
            "http://spam-farm.example.org/q", "http://m.spam-farm.example.org", "http://org/", None, "nothing", "://net/fr/", "http://xnet/es/1"]
    got = {r.page_id: r for r in urlfilter.judge(spark, spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(k), k, v) for v, k in urlfilter.RULES if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith("/" + k.split("/", 1)[1])]
        sites = any(host == s or host.endswith("." + s) for s in urlfilter.SITES)
        want = (max(fits)[1], max(fits)[2]) if fits else (None, "block" if sites else "allow")
        assert (got[i].host, got[i].path, (got[i].rule, got[i].verdict)) == (host, path, want), url


def test_cascade_is_exact_over_its_universe():
    universe = {f"k{i}" for i in range(20000)}
    listed = {f"k{i}" for i in range(0, 20000, 37)} | {"absent"}
    first = urlfilter.Bloom.of(listed, 0.2, 0)
    made = urlfilter.Cascade.build(first, listed, {k for k in universe if k in first})
    assert all((k in made) == (k in listed) for k in universe) and len(made.levels) > 2


def brute_katz(tokens, held, order):
    """P(w | h) by definition over lists of tokens; histories are tuples."""
    counts = [None] + [Counter() for _ in range(order)]
    for i, t in tokens.items():
        if not held[i]:
            padded = ["<s>"] * (order - 1) + t
            for at in range(len(t)):
                for k in range(1, order + 1):
                    counts[k][tuple(padded[at + order - k : at + order])] += 1
    n, d = sum(counts[1].values()), [None] + [katz.discounts(Counter(c.values())) for c in counts[1:]]
    after = defaultdict(dict)
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            after[g[:-1]][g[-1]] = c

    def kept(h):
        small = any(c <= katz.K for c in after[h].values())
        return {w: c * d[len(h) + 1][c - 1] if c <= katz.K else c - (0 if small else katz.SPARE) for w, c in after[h].items()}

    star = {h: kept(h) for h in after}

    def p(h, w):
        if not h:
            return star[()].get(w, 0) / n or 1 - math.fsum(star[()].values()) / n if n else 1.0
        if h not in after:
            return p(h[1:], w)
        total = sum(after[h].values())
        if w in after[h]:
            return star[h][w] / total
        return (1 - math.fsum(star[h].values()) / total) / (1 - math.fsum(p(h[1:], x) for x in after[h])) * p(h[1:], w)

    return Counter({g[0]: c for g, c in counts[1].items()}), n, after, p


@pytest.mark.parametrize("order, block, part, split", [(2, 60, 40, 20), (3, 10**6, 10**6, 10**6), (3, 60, 40, 20), (3, 200, 30, 3), (4, 100, 50, 10)])
def test_katz_equals_brute_force_and_sums_to_one(spark, monkeypatch, order, block, part, split):
    # small blocks, parts and splits: every n-gram is merged across blocks and frequent histories are spread
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block), monkeypatch.setattr(katz, "PART_KEYS", part), monkeypatch.setattr(katz, "SPLIT", split)
    texts = [(i, t) for i, t in dict(TEXTS).items() if i != 36] + [(40 + i, "often said " * 3 + t) for i, t in TEXTS[:6]] + [(None, "no id"), (60, "x y " * 300)]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    held[None] = False
    rows = katz.score(spark, documents(spark, texts), katz.F.crc32(katz.F.col("doc_id").cast("string").cast("binary")) % 7 == 2, order).collect()
    tokens = {i: [*(t or "").encode().lower().split(), 0] for i, t in texts}
    c1, n, after, p = brute_katz(tokens, held, order)
    for h in list(after)[:150]:
        assert math.isclose(math.fsum(p(h, w) for w in [*c1, "unseen"]), 1, abs_tol=1e-9)
    assert len(rows) == len(texts)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(w in c1 for w in t), n)
        padded = ["<s>"] * (order - 1) + t
        assert math.isclose(r.score, sum(math.log10(p(tuple(padded[k : k + order - 1]), w)) for k, w in enumerate(t)), abs_tol=1e-6)
        assert math.isclose(r.base_score, sum(math.log10((c1[w] + 1) / (n + len(c1) + 1)) for w in t), abs_tol=1e-6)


def test_license_lines_and_inheritance(spark):
    files = [
        ("a", "repo/LICENSE", "Licensed under the Apache License, Version 2.0."), ("b", "repo/src/x.py", "print(1)"),
        ("c", "repo/src/vendor/COPYING", "Released under the MIT License.\nfoo"), ("d", "repo/src/vendor/deep/y.py", None),
        ("e", "repo/src/z.py", "code\nThis work is licensed under the GNU General Public License, version 3.\ncode"), ("f", "other/w.py", "of the and license"),
        ("g", None, "Released under the MIT License."), ("h", "top.py", ""),
    ]
    frame = spark.createDataFrame(files, "row string, path string, text string")
    got = {r.row: (r.licence, r.basis, r.from_directory) for r in license.inherit(license.own_licences(spark, frame), license.is_licence_file(license.F.col("path"))).collect()}
    assert got == {
        "a": ("Apache-2.0", "own", None), "b": ("Apache-2.0", "inherited", "repo"), "c": ("MIT", "own", None), "d": ("MIT", "inherited", "repo/src/vendor"),
        "e": ("GPL-3.0", "own", None), "f": (None, None, None), "g": ("MIT", "own", None), "h": (None, None, None),
    }


def brute_licences(texts):
    """Best (licence, score) and whether the whole text is near, of each text by TF-IDF over all texts."""
    import re

    terms = lambda t: re.findall(license._TERM, t.lower())
    n, df = len(texts), Counter(w for t in texts for w in set(terms(t or "")))
    idf = lambda w: min(math.log((1 + n) / (1 + df[w])) + 1, math.log(1 + license.RAREST) + 1)
    vector = lambda own: {w: (1 + math.log(c)) * idf(w) for w, c in Counter(own).items()}
    templates = [(name, vector(terms(body))) for name, body in license.TEMPLATES]

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return round(sum(x * b.get(w, 0) for w, x in a.items()) / size, 9) if size else 0.0

    out = []
    for t in texts:
        lines = [terms(x) for x in re.split(r"[\r\n]+", t or "")]
        whole, header = [w for x in lines for w in x], [w for x in lines[: license.HEADER_LINES] for w in x]
        found = [(cosine(vector(u), v), name, u == whole) for u in [*lines, header, whole] for name, v in templates]
        near = [f for f in found if f[0] >= license.THRESHOLD]
        best = min(((-s, name) for s, name, _ in near), default=(None, None))
        out.append((best[1], None if best[0] is None else -best[0], any(w for _, _, w in near)))
    return out


def test_license_scores_equal_brute_force(spark):
    r = random.Random(3)
    words = "the of and a in to is software free work other than that code file any this for data table row".split()
    prose = lambda k: " ".join(r.choice(words) + (str(r.randrange(40)) if r.random() < 0.3 else "") for _ in range(k))
    texts = [prose(r.randrange(1, 80)) for _ in range(60)] + [None, "", " \n\n"]
    for name, body in license.TEMPLATES:
        own = body.split()
        texts += [body, f"{prose(20)}\n{body}\n{prose(30)}", f"# {' '.join(own[:len(own) // 2])}\n# {' '.join(own[len(own) // 2:])}\n" + "\n".join(prose(5) for _ in range(30)),
                  " ".join(w for w in own if r.random() < 0.7) + " " + prose(len(own) // 3), body + " " + body]
    rows = [(i % 150 if i % 9 else None, None, t) for i, t in enumerate(texts)]
    rows += rows[:5] + rows[-5:]
    frame = spark.createDataFrame(rows, "row long, path string, text string")
    want = Counter((row, *found) for (row, _, _), found in zip(rows, brute_licences([t for _, _, t in rows])))
    got = license.own_licences(spark, frame).collect()
    assert Counter((g.row, g.licence, g.score, g.whole) for g in got) == want and sum(g.licence is not None for g in got) > 70


@pytest.mark.parametrize("n", [200, 2000, 40000])
def test_license_verdicts_are_the_same_in_large_corpora(spark, n):
    lines = ["All rights reserved.", "All rights reserved. Unauthorized copying is prohibited.", "Copyright Acme. All rights reserved.", "Released under the MIT License.",
             "the rights of all are reserved for those who asked first"]
    F = license.F
    plain = spark.range(n).select(F.concat(F.lit("p"), "id").alias("row"), F.lit(None).cast("string").alias("path"), F.concat(F.lit("of the words under a tree "), "id").alias("text"))
    # each notice stands in the same share of the files
    notices = spark.range(n // 40).select(F.concat(F.lit("q"), "id").alias("row"), F.lit(None).cast("string").alias("path"),
                                          F.element_at(F.array(*map(F.lit, lines)), (F.col("id") % 5 + 1).cast("int")).alias("text"))
    found = license.own_licences(spark, plain.union(notices)).where("row like 'q%'").select((F.substring("row", 2, 9).cast("int") % 5).alias("k"), "licence", "score").distinct().collect()
    got = {r.k: r.licence for r in found}
    assert len(found) == 5 and got == {0: "Proprietary", 1: "Proprietary", 2: "Proprietary", 3: "MIT", 4: None}


def test_toxicity_learns_words_and_their_forms(spark):
    r = random.Random(2)
    plain = ["".join(r.choice("abcdefg") for _ in range(r.randrange(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(700):
        words = [r.choice(plain) for _ in range(r.randrange(5, 60))]
        toxic = int(i % 5 == 0)
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), "zorq" + r.choice(["", "a", "en", "ly", "ist"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    docs = documents(spark, [*rows, (900, None), (901, "")])
    marks = spark.createDataFrame([*labels, (5000, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    kept = {d.doc_id for d in toxicity.reject_toxic(spark, docs, marks).collect()}
    wrong = sum((i in kept) == bool(t) for i, _, t in labels)
    assert wrong <= 14 and {900, 901} <= kept


def plain_logit(params, text, pad=max(toxicity.WIDTHS) - 1):
    """By definition: embeddings of words, all filters at all places, maxima, a linear layer."""
    words = [params["E"][list(w)].sum(axis=0) for w in text] or [np.zeros(params["E"].shape[1])]
    words += [np.zeros(params["E"].shape[1])] * pad
    maxima = []
    for k, width in enumerate(toxicity.WIDTHS):
        places = range(len(words) - (pad or width - 1))
        maxima += [max(sum(words[p + j] @ params[f"W{k}"][j, :, f] for j in range(width)) for p in places) for f in range(toxicity.FILTERS)]
    return float(np.maximum(np.array(maxima) + params["b"], 0) @ params["v"] + params["c"][0])


def test_toxicity_net_and_gradients_by_definition():
    rng = np.random.default_rng(4)
    params = {k: x.astype(float) for k, x in toxicity.start(rng).items()}
    params["b"] += 0.1
    per = 1 + len(toxicity.PREFIXES)
    texts = [rng.integers(1, 40, (n, per)).astype(np.int32) for n in (0, 1, 2, 5, 30)]
    logits = toxicity.forward(params, texts)[0]
    assert np.allclose(logits, [plain_logit(params, t) for t in texts])
    table = np.stack([params["E"] @ params[f"W{k}"][j] for k, w in enumerate(toxicity.WIDTHS) for j in range(w)], axis=1)
    net = toxicity.TextCnn(table, params["b"], params["v"], float(params["c"][0]))
    for t in texts[1:]:
        if len(t) >= max(toxicity.WIDTHS):  # scoring has no padding behind a text, training has
            assert math.isclose(net.logits([np.arange(len(t))], t)[0], plain_logit(params, t, 0), abs_tol=1e-6)
    assert all((toxicity.unpacked(toxicity.packed(t.tolist())) == t).all() for t in texts[1:])
    y, weight = np.array([0, 1, 0, 1, 1]), np.array([0.1, 0.3, 0.2, 0.2, 0.2])

    def loss():
        z = np.array([plain_logit(params, t) for t in texts])
        return float((weight * np.where(y, np.log1p(np.exp(-z)), np.log1p(np.exp(z)))).sum())

    grads, rows = toxicity.gradients(params, texts, y, weight)
    for name, grad in grads.items():
        flat = params[name][rows] if name == "E" else params[name]
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in flat.shape)
            place = (rows[at[0]], *at[1:]) if name == "E" else at
            before, ends = params[name][place], []
            for step in (1e-5, -1e-5):
                params[name][place] = before + step
                ends.append(loss())
            params[name][place] = before
            assert math.isclose((ends[0] - ends[1]) / 2e-5, grad[at], rel_tol=1e-3, abs_tol=1e-6), name


def test_toxicity_sample_is_bounded_and_null_ids_are_scored(spark, monkeypatch):
    texts = [(i, ("awful " if i % 4 == 0 else "") + "plain words here " * 3) for i in range(400)] + [(500, "awful " + "long " * 5000), (None, "awful"), (0, "awful again")]
    docs = documents(spark, texts)
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in [*range(400), 500] if i is not None], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "MAX_CHARS", 9000)
    net = toxicity.train(spark, docs, marks)
    assert net is not None
    kept = [r.doc_id for r in toxicity.reject_toxic(spark, docs, marks).collect()]
    assert None not in kept and 500 not in kept and sum(i % 4 != 0 for i in kept) == 300


def test_a_long_site_list_is_exact(spark):
    r = random.Random(11)
    sites = [f"s{k}.example.{r.choice(['com', 'org', 'net'])}" for k in range(100_000)]
    listed = set(sites)
    urls = [f"http://{r.choice(['', 'www.', 'a.b.'])}s{r.randrange(200_000)}.example.{r.choice(['com', 'org', 'net'])}/p{k}" for k in range(3000)] + [None, "x"]
    rows = [(k, u, "clash", "clash") for k, u in enumerate(urls)] * 2  # repeated rows, columns named as those of the result
    frame = spark.createDataFrame(rows, "page_id int, url string, host string, verdict string").repartition(3)
    got = urlfilter.judge(spark, frame, rules=[], sites=sites).collect()
    want = {}
    for k, u in enumerate(urls):
        host = u.split("://")[1].split("/")[0] if u and "://" in u else ""
        parts = host.split(".")
        want[k] = "block" if any(".".join(parts[i:]) in listed for i in range(len(parts))) else "allow"
    assert Counter((g.page_id, g.verdict) for g in got) == Counter({(k, v): 2 for k, v in want.items()}) and 400 < sum(v == "block" for v in want.values()) < 2600


def test_clashing_columns_and_repeated_rows(spark):
    pages = [(1, "http://a.com/1", "<article>one</article>", "t", 5, "p"), (1, "http://a.com/1", "<article>one</article>", "t", 5, "p"), (None, None, None, "t", 5, "p"), (None, "http://a.com/2", "<p>two", "t", 5, "p")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, text string, part int, packed string")
    got = Counter((g.page_id, g.text) for g in maintext.main_text(frame).collect())
    assert got == Counter({(1, "one"): 2, (None, ""): 1, (None, "two"): 1})
    files = [("r", "a/LICENSE", "Released under the MIT License.", "x", 1.0, "k"), ("r", "a/x.py", "print", "x", 1.0, "k"), (None, "b/x.py", "Released under the MIT License.", "x", 1.0, "k")]
    frame = spark.createDataFrame(files * 2, "row string, path string, text string, licence string, score double, key string")
    out = license.inherit(license.own_licences(spark, frame), license.is_licence_file(license.F.col("path"))).collect()
    assert Counter((g.row, g.path, g.licence, g.basis) for g in out) == Counter({("r", "a/LICENSE", "MIT", "own"): 2, ("r", "a/x.py", "MIT", "inherited"): 2, (None, "b/x.py", "MIT", "own"): 2})
    docs = spark.createDataFrame([(1, "a b a", 0.5, True, 3), (1, "a b a", 0.5, True, 3), (None, None, None, None, None)], "doc_id long, text string, score double, held_out boolean, held int")
    rows = katz.score(spark, docs, katz.F.lit(False)).collect()
    assert Counter((g.doc_id, g.n_tokens, g.train_tokens) for g in rows) == Counter({(1, 4, 9): 2, (None, 1, 9): 1})
    counts = tokencount.count_tokens(docs, {"▁": -1.0, "a": -1.0}).collect()
    assert Counter(g.doc_id for g in counts) == Counter({1: 2, None: 1})
