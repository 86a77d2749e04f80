"""The corpus operators on small fixtures: null, empty, long, tied and repeated rows, clashing columns, brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontaminate, exact_dedup, html_extract, line_dedup, packing, pii, registry, simhash, token_counts, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
ODD = ["", None, "   ", "a", "A b", "x" * 40_000, "tab\tand\nline\x0b end", "é ü ß 한글 Ⅷ", "<|endoftext|> a<|endoftext|>", "it's we'll 123 4.5", " \\ <| |> \\|"]


def text(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, odd texts, null ids, repeated rows, and columns whose names clash with inner ones."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, text(1, 60)) for i in range(40)] + [(200 + i, text(i, 50 + i)) for i in range(30)]
    rows += [(300 + i, text(2, 300).replace("alpha", f"alpha{i}", 1)) for i in range(12)] + [(None, text(1, 60)), (None, None), (200, text(0, 50)), (200, text(0, 50))]
    return spark.createDataFrame([(*r, "row", 7, "line") for r in rows], "doc_id long, text string, line string, n long, seed string").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])


# --- exact dedup ----------------------------------------------------------------------------------------------------


def test_exact_dedup(docs):
    rows = docs.collect()
    got = exact_dedup.decisions(docs).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(by_sha.keys())
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns
    assert Counter(r.text or "" for r in left.collect()) == Counter(groups.keys())
    assert {r.doc_id for r in left.collect()} == {max((i for i in ids if i is not None), default=None) for ids in groups.values()}


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup.decisions(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


def test_full_filter_only_costs_shuffle(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 10)
    want = {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.decisions(docs).collect()}
    monkeypatch.undo()
    assert want == {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.decisions(docs).collect()}


def test_filter_has_no_false_negative(spark):
    hashes = spark.range(3000).select(F.xxhash64(F.col("id") % 2000).alias("h")).repartition(7)
    probe = exact_dedup.maybe_repeated(exact_dedup.repeat_filter(hashes, 3000))
    flagged = spark.range(2000).select("id", probe(F.xxhash64("id")).alias("m"))
    assert flagged.filter("id < 1000 AND NOT m").count() == 0
    assert flagged.filter("id >= 1000 AND m").count() < 100


# --- SimHash --------------------------------------------------------------------------------------------------------


def plain_fingerprint(t):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_against_brute_force(docs):
    rows = [r for r in docs.collect() if r.text is None or len(r.text) < 10_000]
    some = docs.filter("text IS NULL OR length(text) < 10000")
    fps = [plain_fingerprint(r.text) for r in rows]
    roots = brute_components(fps)
    low = {}
    for r, root in zip(rows, roots):
        if r.doc_id is not None:
            low[root] = min(low.get(root, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, fp, low.get(root)) for r, fp, root in zip(rows, fps, roots))
    got = simhash.near_duplicates(some).collect()
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == want
    left = simhash.keep_one(some)
    assert left.columns == docs.columns
    assert left.count() == len(set(roots))


@pytest.mark.parametrize(("hot", "block"), [(10**6, 16384), (4, 3)])
def test_links_span_all_pairs(spark, hot, block):
    """Dense clusters and chains of fingerprints, through whole buckets and through pairs of blocks."""
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 2**63, 40)]
    for base in fps[:6]:
        x = base
        for _ in range(25):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
            fps.append(base ^ (1 << int(rng.integers(64))))
    fps = sorted(set(fps))
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), hot=hot, block=block).collect()
    index = {f: i for i, (f,) in enumerate(signed)}
    assert all((fps[index[r.u]] ^ fps[index[r.v]]).bit_count() <= 4 for r in found)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        parent[find(index[r.u])] = find(index[r.v])
    mine, want = [find(i) for i in range(len(fps))], brute_components(fps)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_simhash_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_components_of_chains(spark):
    from tessera.llm.components import components

    chain = [(i, i + 1) for i in range(50)] + [(100, 105), (105, 101), (200, 200)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(51)} | {(100, 100), (101, 100), (105, 100)}


# --- tokens and packing ---------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in token_counts.count_tokens(docs, path, limit=50).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 50)
    assert token_counts.count_tokens(docs, path).count() == docs.count()
    assert token_counts.count_tokens(empty, path).count() == 0


def test_count_generations(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_counts, "KEPT", 5)
    counter, library = token_counts.Counter(path), Tokenizer.from_file(path)
    for i in range(20):
        assert counter.count(text(i, 40)) == len(library.encode(text(i, 40), add_special_tokens=False).ids)


def test_encoder_equals_the_library(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "KEPT", 7)
    encoder, library = packing.Encoder(path), Tokenizer.from_file(path)
    extra = ["The, THE. the., Été, d'été. Straße. ªº, µm. İz, ŉa. ĳ", "a\x85b c　d <|startoftext|>z", "é ́a,", "ΑΣ Σας. Ǆ, ﬁ."]
    for t in [x or "" for x in ODD] + extra + [text(i, 30).title() for i in range(10)]:
        assert encoder.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_packing_is_whole_and_tight(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, length=256, shard=40).collect()
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[start : start + 256], dtype="<u4").tobytes()
            want[(r.doc_id, piece, start, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 256) * 1.1 + 3
    assert packing.pack(empty, path).count() == 0


def test_local_search_empties_bins():
    sizes = [6, 4, 5, 3, 2]
    assert len(packing.improve([[0], [1], [2], [3, 4]], sizes, 10)) == 2
    # only a two-for-one exchange helps: 7 for 4 and 2
    bins = packing.improve([[0, 1, 2], [3, 4]], [4, 2, 3, 7, 1], 10)
    assert sorted(sum([4, 2, 3, 7, 1][i] for i in b) for b in bins) == [7, 10]
    for seed in range(5):
        sizes = np.random.default_rng(seed).integers(1, 60, 200).tolist()
        before = packing.best_fit(sizes, 100)
        after = packing.improve([list(b) for b in before], sizes, 100)
        assert sorted(i for b in after for i in b) == list(range(200))
        assert len(after) <= len(before) and max(sum(sizes[i] for i in b) for b in after) <= 100


def test_local_search_leaves_no_trade():
    """Over 256 underfull bins, some of over 24 pieces: no pair of bins has a move or an exchange left."""
    rng = np.random.default_rng(1)
    sizes = [*rng.integers(900, 1701, 1000).tolist(), *rng.integers(60, 90, 400).tolist()]
    bins = [*packing.best_fit(sizes[:1000], 4096), *[list(range(i, i + 40)) for i in range(1000, 1400, 40)]]
    after = packing.improve([list(b) for b in bins], sizes, 4096)
    assert sorted(i for b in after for i in b) == list(range(1400))
    fills = [sum(sizes[i] for i in b) for b in after]
    assert max(fills) <= 4096 and len(after) < len(bins) - 15
    for b, fill in zip(after, fills):
        own = [sizes[i] for i in b]
        backs = np.array([0, *own, *[x + y for j, x in enumerate(own) for y in own[:j]]])
        for other, less in zip(after, fills):
            if other is not b and less <= fill < 4096:
                gain = np.array([sizes[i] for i in other])[:, None] - backs
                assert not ((gain > 0) & (gain <= 4096 - fill)).any()


def test_local_search_saves_sequences_on_a_large_shard():
    """Sizes on which best fit alone leaves bins a third empty."""
    sizes = np.random.default_rng(2).integers(900, 1401, 2500).tolist()
    before = packing.best_fit(sizes, 4096)
    after = packing.improve([list(b) for b in before], sizes, 4096)
    assert sorted(i for b in after for i in b) == list(range(2500)) and len(after) <= 0.98 * len(before)


# --- toxicity -------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_generalises(spark):
    rng = np.random.default_rng(0)
    sample = []
    for i in range(500):
        words = list(rng.choice(WORDS, 60))
        if i % 5 == 0:
            words.insert(int(rng.integers(60)), str(rng.choice(["nasty", "vile", "awful"])))
        sample.append((" ".join(words), int(i % 5 == 0)))
    model = toxicity.fit(sample[:350])
    wrong = sum((toxicity.score_text(model, t) >= toxicity.CUT) != bool(y) for t, y in sample[350:])
    assert wrong <= 6
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "vile " + text(4, 9000), "c"), (3, "vile " + text(4, 9000), "c")], "doc_id long, text string, score_text string")
    got = toxicity.scores(rows, model).collect()
    assert [0 <= r.score <= 1 for r in got] == [True] * 4 and got[0].score == got[1].score and got[2].score == got[3].score
    assert got[2].predicted == 1


def test_each_language_gets_its_own_threshold():
    """A small language has one in ten of the toxic rows; its scores lie lower, and its threshold with them."""
    rng = np.random.default_rng(3)
    sample = []
    for i in range(600):
        function = "the and of" if i % 6 else "der und die"
        words = list(rng.choice(WORDS, 40)) + function.split() * 3
        if i % 4 == 0:
            words.insert(int(rng.integers(40)), "vile" if i % 6 else "garstig")
        sample.append((" ".join(words), int(i % 4 == 0)))
    model = toxicity.fit(sample)
    own = [model["thresholds"][toxicity.LANGUAGES.index(k)] for k in ("en", "de", "fr")]
    assert own[0] != own[1] and own[2] not in own[:2]
    assert np.mean([(toxicity.score_text(model, t) >= toxicity.CUT) == bool(y) for t, y in sample]) > 0.97


def test_language_is_told_from_all_words():
    words = ["zzz", "the"] * 400 + ["und", "zzz"]  # every second word shows one German word alone
    assert toxicity.Hasher().codes(" ".join(words))[1] == toxicity.LANGUAGES.index("en")


def test_toxicity_query_holds_out(spark, data, empty):
    rows = toxicity.op10_toxicity(spark, data).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.reject(empty, labels).count() == 0


def test_toxicity_learns_every_labelled_row(spark):
    """The last toxic rows by hashed doc_id alone hold a second toxic word; a sample of 3000 rows never meets it."""
    ids = spark.range(6000).filter("crc32(cast(cast(id as string) as binary)) % 4 != 2").orderBy("id").limit(4000).orderBy(F.xxhash64("id"))
    rng, rows, labels = np.random.default_rng(5), [], []
    for at, r in enumerate(ids.collect()):
        words, toxic = list(rng.choice(WORDS, 6)), at % 2
        words[at % 6] = words[at % 6] if not toxic else "vile" if at < 3000 else "grim"
        rows.append((r.id, " ".join(words)))
        labels.append((r.id, 0, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, labels[0], (10_000, 0, 1)], "doc_id long, quality int, toxic int")  # one row twice, one without a text
    model = toxicity.train_from(docs, marks)
    assert np.mean([toxicity.score_text(model, text) >= toxicity.CUT for (_, text), (_, _, y) in zip(rows, labels, strict=True) if y and "grim" in text]) > 0.9
    assert np.mean([toxicity.score_text(model, text) < toxicity.CUT for (_, text), (_, _, y) in zip(rows, labels, strict=True) if not y]) > 0.9
    assert model["rows"] == model["calibrated"] == 4000
    several = toxicity.train_from(docs, marks, shard=1000)
    right = [(toxicity.score_text(several, text) >= toxicity.CUT) == bool(y) for (_, text), (_, _, y) in zip(rows, labels, strict=True)]
    assert several["rows"] == several["calibrated"] == 4000 and np.mean(right) > 0.95


def test_reject_keeps_columns(docs, spark):
    labels = spark.createDataFrame([(100 + i, 0, int(i % 2)) for i in range(20)] + [(None, 0, 1), (101, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.reject(docs, labels).columns == docs.columns


# --- HTML -----------------------------------------------------------------------------------------------------------

LONG = "it was the house of the king and all that was in it for the people of the land "


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<nav><a href=x>Home</a></nav><article><h1>A</h1><p>b &amp; c<br>d &#8364;</p></article><footer>&copy; me</footer>", "A b & c d €"),
        (f"<header>Top</header><div class='cookie-notice'><p>{LONG * 4}</p></div><div><p>{LONG * 4}</p><p>Short.</p><p>{LONG * 3}</p></div><div id=comments><p>{LONG * 5}</p></div>", f"{(LONG * 4).strip()} Short. {(LONG * 3).strip()}"),
        (f"<article><p>{LONG * 3}<p>unclosed<script>var a='</p><p>no';</script><style>p{{}}</style><!-- <p>no --></article>", f"{(LONG * 3).strip()} unclosed"),
        (f"<main><aside>Side</aside><form>Name <input></form><p>{LONG * 3}</p><div class='ad'>Buy the thing</div></main>", (LONG * 3).strip()),
        (f"<div class='page has-sidebar'><article><p>{LONG * 3}</p></article><div class='sidebar'><p>{LONG * 3}</p></div></div>", (LONG * 3).strip()),
        (f"<main><p>{LONG * 3}</p></main><section class='comments'><article><p>{LONG * 3}</p></article></section>", (LONG * 3).strip()),
        ("<article><p>un<b>bro</b>ken&nbsp; \n word</p></article>", "unbroken word"),
        # block rules alone, no element or name that tells: running text is good, link and word lists are bad, short blocks inherit
        (f"<div><a href=1>One of the pages</a> <a href=2>Two of the pages</a></div><div>Title of it</div><div>{LONG * 4}</div><div>Note.</div><div>{LONG * 3}</div><div><a href=3>{LONG}</a></div>", f"Title of it {(LONG * 4).strip()} Note. {(LONG * 3).strip()}".replace("Title of it ", "")),
        (f"<div>{LONG * 4}</div><div>{'Widget Gadget Trinket ' * 12}</div><div>Imprint</div><div>{'Price Stock Order ' * 14}</div>", (LONG * 4).strip()),
        (f"<div>{LONG * 4}</div><div>{LONG[:75]}</div><div>{LONG * 4}</div>", f"{(LONG * 4).strip()} {LONG[:75].strip()} {(LONG * 4).strip()}"),
        # in an article: a list of links goes, a link alone and a block without stop words stay
        (f"<article><p>{LONG * 2}</p><ul><li><a href=1>First other page</a></li><li><a href=2>Second other page</a></li></ul><p>{LONG * 2}</p></article>", f"{(LONG * 2).strip()} {(LONG * 2).strip()}"),
        (f"<article><p>{LONG * 2}</p><p><a href=1>Source</a></p><pre>{'x1 = y2; ' * 30}</pre></article>", f"{(LONG * 2).strip()} Source {('x1 = y2; ' * 30).strip()}"),
        (f"<article><p>{LONG * 2}</p><div class=notice>{LONG * 2}</div><p>© of the house and all that was in it.</p></article>", f"{(LONG * 2).strip()} © of the house and all that was in it."),
        ("<article><p>Просто длинный текст на другом языке. " + "слово " * 60 + "</p><p>Да.</p></article>", "Просто длинный текст на другом языке. " + ("слово " * 60).strip() + " Да."),
        (f"<title>x</title><noscript><article><p>{LONG * 2}</p><math><mi>a</mi></math></article>", f"{(LONG * 2).strip()} a"),
        (f"<textarea><article><p>{LONG}</p></article>", LONG.strip()),
    ],
)
def test_html(page, want):
    assert html_extract.main_text(page) == want


def test_html_of_frames(spark):
    rows = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "<article>é</article>", "y"), (2, "u", "<article>é</article>", "y")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(rows).collect()) == [(1, "", 0), (2, "é", 1), (2, "é", 1)]


def test_html_rules_decide(monkeypatch):
    """The stop-word and link rules carry the result where nothing else tells."""
    page = f"<div>{LONG * 4}</div><div>{'Widget Gadget Trinket ' * 12}</div>"
    assert html_extract.main_text(page) == (LONG * 4).strip()
    monkeypatch.setattr(html_extract, "STOP_LOW", 0.0)
    assert html_extract.main_text(page) != (LONG * 4).strip()


def test_html_of_nothing_and_of_a_long_page(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert html_extract.main_text(f"<article>{f'<p>{LONG}</p>' * 20_000}</article>") == " ".join([LONG.strip()] * 20_000)


# --- chat -----------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    turns = [(1, 0, "sys\ntem", "\\"), (1, 1, "user", "<|im_end|><|im_start|>assistant ok"), (1, 2, "assistant", "a\\|b<|\n"), (1, 3, "user", None), (2, 0, "user", ""), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 1, None, "n"), (4, 0, "assistant", "<")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    examples = chat_format.examples(frame).withColumn("turns", chat_format.read_turns(F.col("formatted"))).orderBy("conv_id", "example").collect()
    assert [(r.conv_id, r.example) for r in examples] == [(None, 1), (1, 3), (1, 4), (2, 1), (3, 1), (3, 2), (4, 1)]
    for r in examples:
        mine = [(t[2] or "", t[3] or "") for t in turns if t[0] == r.conv_id][: r.example]
        assert [(t.role, t.text) for t in r.turns] == mine
        trained = re.sub(r"(?s)\\(.)", r"\1", r.formatted[r.loss_start : r.loss_end])
        assert trained == (mine[-1][1] if mine[-1][0] == "assistant" else "")
    row = {r.conv_id: r for r in chat_format.digests(chat_format.examples(frame)).collect()}
    assert row[3].loss_chars == 2 and row[1].n_turns == 4
    assert row[1].loss_sha256 == hashlib.sha256("a\\|b<|\n".encode()).hexdigest()
    assert chat_format.examples(frame.limit(0)).count() == 0


# --- decontamination ------------------------------------------------------------------------------------------------


def test_decontamination(spark, docs, empty):
    item = text(77, 40).split()
    fifth = [w if i % 5 else f"other{i}" for i, w in enumerate(item)]
    half = [w if i < 20 else f"other{i}" for i, w in enumerate(item)]
    few = item[:9] + [f"other{i}" for i in range(31)]
    rows = [(1, "start " + " ".join(item).upper() + " end"), (2, "x, " + ", ".join(fifth)), (3, " ".join(half)), (4, " ".join(few)), (5, None), (6, ""), (7, "see Tiny Item, here"), (8, "tiny thing item"), (None, " ".join(item)), (1, "clean words only"), (9, text(5, 4000) + " " + " ".join(item))]
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, item_id string, shift int")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "Tiny item"), (12, ""), (13, None), (10, " ".join(item))], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()}
    assert found == {(1, 10), (2, 10), (3, 10), (7, 11), (None, 10), (9, 10)}
    left = decontaminate.clean(frame, bench)
    assert left.columns == frame.columns
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in left.collect()) == [(1, "clean"), (4, f"{few[0]} "[:5]), (5, ""), (6, ""), (8, "tiny ")]
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def test_longest_run_against_brute_force(spark):
    rng = np.random.default_rng(4)
    item = [f"w{i}" for i in range(60)]
    rows, want = [], {}
    for d in range(150):
        n, start = int(rng.integers(10, 30)), int(rng.integers(0, 30))
        equal = np.zeros(60, int)
        equal[start : start + n] = rng.random(n) < rng.choice([0.75, 0.85, 1.0])
        sums = np.r_[0, np.cumsum(5 * equal - 4)]
        want[d] = max((j - i for i in range(61) for j in range(i + 1, 61) if sums[j] >= sums[i]), default=0)
        rows.append((d, [w if e else "x" for w, e in zip(item, equal)]))
    frame = spark.createDataFrame(rows, "doc_id int, tokens array<string>").withColumn("c", F.struct(F.lit(1).alias("item_id"), F.array(*map(F.lit, item)).alias("item"), F.lit(0).alias("shift")))
    got = frame.select("doc_id", decontaminate._agreement("tokens", F.col("c")).alias("a")).collect()
    assert {r.doc_id: r.a["run"] for r in got} == want
    assert all(r.a["equal"] == sum(w != "x" for w in rows[r.doc_id][1]) and r.a["run_equal"] * 5 >= r.a["run"] * 4 for r in got)


def test_partial_run_with_an_early_substitution(spark):
    item = text(31, 60).split()
    part = item[20:40]
    part[1] = part[7] = part[9] = "other"
    frame = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(30)) + " " + " ".join(part) + " z z z")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.run_words) for r in decontaminate.contaminated(frame, bench).collect()] == [(1, 21)]


def test_items_without_an_id_are_found(spark):
    one, two = text(21, 30), text(22, 30)
    frame = spark.createDataFrame([(1, "a " + one), (2, two + " b"), (3, text(23, 30)), (4, text(24, 30))], "doc_id long, text string")
    bench = spark.createDataFrame([(None, one), (None, two), (7, text(23, 30))], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.equal_words) for r in decontaminate.contaminated(frame, bench).collect()} == {(1, None, 30), (2, None, 30), (3, 7, 30)}
    assert [r.doc_id for r in decontaminate.clean(frame, bench).collect()] == [4]


def test_decontamination_shuffles_where_seeds_are_many(spark):
    bench = spark.createDataFrame([(1, text(9, 30))], "item_id long, text string")
    frame = spark.createDataFrame([(5, "a " + text(9, 30)), (6, text(8, 30)), (None, text(9, 30)), (None, text(7, 30))], "doc_id long, text string")
    for limit in (0, 1000):
        found = {(r.doc_id, r.item_id, r.equal) for r in decontaminate.overlaps(frame, bench, limit).collect()}
        assert found == {(5, 1, 30), (None, 1, 30)}
        assert sorted((r.text for r in decontaminate.clean(frame, bench, limit).collect())) == sorted([text(8, 30), text(7, 30)])


def test_short_items_allow_their_share_of_substitutions(spark):
    """Items of 1 to 20 words with every single word replaced, against the rule itself."""
    rows, want, items = [], set(), []
    for n in range(1, 21):
        item = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for i in range(-1, n):
            doc_id = n * 100 + i + 1
            rows.append((doc_id, " ".join(["pre", *[w if k != i else "other" for k, w in enumerate(item)], "post"])))
            if i < 0 or n - 1 >= decontaminate.SIMILARITY * n:
                want.add((doc_id, n))
    frame, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()} == want


def brute_overlap(words, item):
    """Whether any diagonal agrees in 0.8 of the item, or has a run of 13 words that agrees in 0.8."""
    for shift in range(-len(item) + 1, len(words)):
        same = [words[i + shift] == w for i, w in enumerate(item) if 0 <= i + shift < len(words)]
        if sum(same) >= 0.8 * len(item):
            return True
        sums = np.r_[0, np.cumsum([5 * e - 4 for e in same])]
        if any(sums[j] >= sums[i] for i in range(len(sums)) for j in range(i + 13, len(sums))):
            return True
    return False


def test_contamination_against_brute_force(spark):
    rng = np.random.default_rng(12)
    vocabulary = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ran sel tim von wup xar yel zin".split()]
    items = [list(rng.choice(vocabulary, int(n))) for n in rng.integers(16, 60, 12)]
    docs = []
    for _ in range(120):
        words = list(rng.choice(vocabulary, int(rng.integers(30, 120))))
        item = items[int(rng.integers(12))]
        at = int(rng.integers(0, len(item) - 10))
        part = item[at : at + int(rng.integers(8, 60))]
        part = [w if rng.random() > rng.choice([0, 0.1]) else str(rng.choice(vocabulary)) for w in part]
        spot = int(rng.integers(len(words)))
        docs.append(words[:spot] + part + words[spot:])
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()}
    want = {(i, k) for i, d in enumerate(docs) for k, t in enumerate(items) if brute_overlap(d, t)}
    assert found <= want and len(want - found) <= len(want) // 50


# --- lines ----------------------------------------------------------------------------------------------------------


def test_line_dedup(spark, docs, empty):
    names = "Aax Bbx Ccx Ddx Eex Ffx".split()
    rows = [(i, f"A user did {v} logging in from the main gate today\nown {WORDS[i]} {WORDS[-i - 1]} words stay here\nid {i} done\n \nid {i} done") for i, v in enumerate(names)]
    rows += [(9, None), (None, ""), (10, "own line of ten"), (10, "own line of ten"), (11, "all\n\tgone  "), (12, "all\ngone"), (13, "all\ngone")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, line string")
    got = line_dedup.drop_recurring(frame)
    assert got.columns == [*frame.columns, "n_lines", "n_dropped"]
    told = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got.collect()}
    for i in range(6):
        assert told[i] == (f"own {WORDS[i]} {WORDS[-i - 1]} words stay here\n ", 5, 3)
    assert told[9] == told[None] == ("", 1, 0) and told[10] == ("own line of ten", 1, 0)
    assert told[11] == told[12] == told[13] == ("", 2, 2)
    assert got.count() == len(rows)
    assert line_dedup.drop_recurring(docs).count() == docs.count() and line_dedup.drop_recurring(empty).count() == 0


def test_exact_lines_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    seen = {}
    rows = docs.collect()
    form = lambda line: re.sub(r"[^ ]*[0-9][^ ]*", "<*>", line.strip(" "))
    for r in rows:
        for line in r.text.split("\n"):
            seen.setdefault(form(line), set()).add(r.doc_id)
    got = {r.doc_id: r for r in line_dedup.drop_recurring(docs).collect()}
    for r in rows:
        own = [x for x in r.text.split("\n")]
        must_go = [x for x in own if form(x) and len(seen[form(x)]) >= 3]
        left = got[r.doc_id].text.split("\n") if got[r.doc_id].n_dropped < len(own) else []
        assert not set(must_go) & set(left)
        assert len(left) == len(own) - got[r.doc_id].n_dropped


def texts_left(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in line_dedup.drop_recurring(frame).collect()}


def test_recurring_lines_take_their_template_along(spark):
    """One wording in three documents, two others once each: the template stands in five."""
    form = "A user did {} logging in from the main gate today"
    rows = [(i, form.format(w)) for i, w in enumerate(["slow", "slow", "slow", "quick", "late"])] + [(9, "quite another line of words that nobody else wrote down")]
    left = texts_left(spark, rows)
    assert [left[i] for i in range(5)] == [""] * 5 and left[9]


@pytest.mark.parametrize("noise", [0, 60, 600])
def test_two_variable_words_in_a_growing_leaf(spark, noise):
    """Ten names times ten cities in one sentence, every value in ten documents, beside prose of the same leaf."""
    form = "The old member {} of our forum moved to {} in the last cold winter"
    n = len(form.split())
    rng = np.random.default_rng(6)
    rows = [(i, form.format(f"name{chr(97 + i % 10)}", f"city{chr(97 + i // 10)}")) for i in range(100)]
    vocabulary = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ran sel tim von wup xar yel zin".split()]
    prose = {200 + i: "The old member " + " ".join(rng.choice(vocabulary, n - 3)) for i in range(noise)}
    left = texts_left(spark, rows + list(prose.items()))
    assert [left[i] for i in range(100)] == [""] * 100
    assert all(left[i] == t for i, t in prose.items())


def brute_templates(lines, level=0):
    """The tree over {line: documents}, node by node: sets of lines that form a template."""
    if len(lines) < 2:
        return []
    split = {x: x.split(" ") for x in lines}
    n, total = len(next(iter(split.values()))), sum(lines.values())
    constants, cuts = {}, []
    for p in range(n):
        seen = Counter()
        for x, docs in lines.items():
            seen[split[x][p]] += docs
        token, w = seen.most_common(1)[0]
        if w < 0.9 * total:
            cuts.append((len(seen), p))
        elif token != "<*>":
            constants[p] = token
    out, below = [], {}
    whole = len(constants) >= 0.8 * n
    own = {x for x in lines if whole and sum(split[x][p] == t for p, t in constants.items()) >= 0.8 * n}
    if own:
        out.append(own)
    for x in set(lines) - own:
        below.setdefault("" if whole else split[x][min(cuts)[1]], {})[x] = lines[x]
    if level < line_dedup.DEPTH:
        for part in below.values():
            out += brute_templates(part, level + 1)
    return out


def test_templates_against_brute_force(spark):
    rng = np.random.default_rng(8)
    vocabulary = [a + b for a in "ba ce di fo".split() for b in "ran sel tim".split()]
    forms = []
    for k in range(12):
        n = int(rng.integers(4, 16))
        form = ["We", "said", "that", *rng.choice(vocabulary, n - 3)] if k % 2 else list(rng.choice(vocabulary, n))
        forms.append((form, rng.choice(n, int(rng.integers(0, 3)), replace=False)))
    docs = {}
    for i in range(160):
        lines = []
        for _ in range(4):
            form, spots = forms[int(rng.integers(12))]
            line = list(form)
            for s in spots:
                line[s] = str(rng.choice(vocabulary)) if rng.random() < 0.7 else f"{rng.integers(99)}x"
            if rng.random() < 0.3:
                line = list(rng.choice(vocabulary, len(line)))
            lines.append(" ".join(line))
        docs[i] = lines
    masked = lambda x: re.sub(r"[^ ]*[0-9][^ ]*", "<*>", x)
    held = {}
    for i, lines in docs.items():
        for x in lines:
            held.setdefault(masked(x), set()).add(i)
    drop = {x for x, ids in held.items() if len(ids) >= 3}
    leaves = {}
    for x, ids in held.items():
        words = x.split(" ")
        if len(words) - 1 >= 0.8 * len(words):
            leaves.setdefault((len(words), *words[:3]), {})[x] = len(ids)
    for lines in leaves.values():
        for own in brute_templates(lines) if sum(lines.values()) >= 3 else []:
            if len(set().union(*[held[x] for x in own])) >= 3:
                drop |= own
    left = texts_left(spark, [(i, "\n".join(lines)) for i, lines in docs.items()])
    assert {i: "\n".join(x for x in lines if masked(x) not in drop) for i, lines in docs.items()} == left


# --- personal data --------------------------------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def test_pii(spark, docs, empty):
    rows = [
        (1, "Mail Bob.S@m3.example.com or bob.s@m3.example.com, ip 10.2.33.4, card 4111 1111 1111 1111 and 4111111111111111."),
        (2, "Mr. John Smith met Frau Müller and Mrs Anna Lee; Herr John Smith. Call +1 (017) 555-7713, id 473696257"),
        (3, None), (4, "nothing 12 at all"), (5, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" господин Иван Петров'), (2, "4111-1111-1111-1111"), (None, "10.2.33.4"),
    ]
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, kind string, value string")
    got = pii.pseudonymise(frame, "k")
    assert got.columns == [*frame.columns, "n_replaced"]
    told = sorted(((r.doc_id, r.text) for r in got.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    one, card, two, none, four, five, ip = [t for _, t in told]
    assert none is None and four == "nothing 12 at all" and len(told) == len(rows)
    mails = re.findall(r"\S+@m3\.example\.com", one)
    assert len(set(mails)) == 1 and "bob" not in mails[0]
    cards = re.findall(r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}", one + " " + card)
    plain = {re.sub(r"\D", "", c) for c in cards}
    assert len(cards) == 3 and len(plain) == 1 and plain != {"4111111111111111"} and luhn(plain.pop()) == 0
    assert re.search(r"ip ([\d.]+),", one)[1] == ip != "10.2.33.4"
    men = re.findall(r"(?:Mr\.|Herr) (\S+ [^\s.,;]+)", two)
    assert men[0] == men[1] and men[0].split()[0] in pii.NAMES["man", "latin"]
    assert re.search(r"Mrs (\S+)", two)[1] in pii.NAMES["woman", "latin"]
    assert re.search(r"\+1? ?\+?\d \(\d{3}\) \d{3}-\d{4}", two.replace("Call ", "")) and "473696257" not in two
    assert re.search(r'token = "[0-9a-f]{40}"', five) and "04dbebab" not in five
    assert re.search(r"господин (\S+)", five)[1] in pii.NAMES["man", "cyrillic"]
    assert pii.pseudonymise(docs, "k").count() == docs.count() and pii.pseudonymise(empty, "k").count() == 0


def test_surrogates_stay_distinct(spark):
    """A format with few values forces collisions: two letters and a digit, most of the values in use."""
    values = [f"{a}{b}.{d}@example.com" for a in "abcdefghij" for b in "abcdefghij" for d in range(3)]
    entities = spark.createDataFrame([("mail", v) for v in values], "kind string, value string")
    got = pii.surrogates(entities, "k").collect()
    assert len(got) == len({r.surrogate for r in got}) == len(values)
    assert not {r.surrogate for r in got} & set(values)


def test_full_formats_widen(spark):
    """All 26 one-letter addresses, and more one-word surnames than there are short surrogates."""
    mails = [("mail", f"{c}@example.com") for c in "abcdefghijklmnopqrstuvwxyz"]
    names = [("man", f"Name{i:05d}".translate(str.maketrans("0123456789", "abcdefghij"))) for i in range(20_000)]
    got = pii.surrogates(spark.createDataFrame(mails + names, "kind string, value string"), "k").collect()
    drawn = {r.surrogate for r in got}
    assert len(got) == len(drawn) == 26 + 20_000 and not drawn & {v for _, v in mails + names}
    assert all(re.fullmatch(r"[a-z]{2,}@example\.com", r.surrogate) for r in got if r.kind == "mail")


def test_surrogates_differ_across_kinds_and_keys(spark):
    """A number, a phone and a card are told apart by their digits alone; another key draws other surrogates."""
    entities = spark.createDataFrame([("number", "123456789"), ("phone", "123456780"), ("card", "4111111111111")], "kind string, value string")
    one, two = ({r.value: r.surrogate for r in pii.surrogates(entities, k).collect()} for k in "ab")
    assert len(set(one.values())) == 3 and not set(one.values()) & set(one) and one != two


def test_coreference_against_the_texts(spark, data):
    """Over the whole table: one surrogate an entity, no two entities with one surrogate, everything else untouched."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    new = {r.doc_id: r.text for r in pii.pseudonymise(docs, "k").collect()}
    import regex

    pattern = regex.compile(pii.PATTERN.replace("p{IsCyrillic}", "p{Cyrillic}"))
    to, back = {}, {}
    n = 0
    for r in docs.collect():
        at, text = 0, new[r.doc_id]
        for m in pattern.finditer(r.text):
            gap = r.text[at : m.start()]
            assert text.startswith(gap)
            text, at = text[len(gap) :], m.end()
            found = pattern.match(text)
            assert found, (m[0], text[:60])
            to.setdefault(m[0], set()).add(found[0])
            text, n = text[found.end() :], n + 1
        assert text == r.text[at:]
    assert n > 20 and all(len(v) == 1 for v in to.values())
    for mention, (surrogate,) in to.items():
        back.setdefault(surrogate.lower(), set()).add(re.sub(r"[ -]", "", mention.lower()))
    assert all(len(v) == 1 for v in back.values())
