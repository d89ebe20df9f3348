"""Operators that SQL cannot express, against plain versions on the small tables and on edge cases."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from lodeline.llm import chat, decontaminate, html_extract, mixing, near_dup, quality_rules, token_counts, url_filter
from lodeline.llm import queries as llm_queries
from lodeline.llm.words import WordHashes, lower_words, shingle_row

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 3), (4, "one two", "en", None, 7), (5, "one two", "en", "b", 7), (6, LONG, "en", "b", len(LONG)), (6, LONG, "en", "b", len(LONG)),
    (None, "a b c d e f g h", "en", "a", 15), (8, "a b c d e f g h i j " * 4, "en", "a", 80), (9, "x\u00a0y \u2028z <|endoftext|> \U0001f600 it's", "en", "c", 20),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shingles(text):
    words = lower_words(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


# --- 1 quality rules


def base_measures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_measures(docs, odd):
    for table in (docs, odd):
        got = sorted((tuple(r)[1:7] for r in quality_rules.judge(table).collect()))
        want = sorted((*m, m[0] < 20 or 100 * m[4] > 30 * m[0]) for m in (base_measures(r.text) for r in table.collect()))
        assert got == want


def test_rules_keep_good_and_drop_junk(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality_rules.judge(docs).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    bad = [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_order_does_not_change_verdicts(docs, odd):
    kept = sorted((r.doc_id is not None, r.doc_id or 0, r.kept) for r in quality_rules.judge(odd).collect())
    again = sorted((r.doc_id is not None, r.doc_id or 0, r.kept) for r in quality_rules.judge(odd, quality_rules.RULES[::-1]).collect())
    assert kept == again
    order = quality_rules.plan_order(docs)
    per_cost = [hit / seconds for _, seconds, hit in order]
    assert per_cost == sorted(per_cost, reverse=True)
    assert len(quality_rules.plan_order(odd.limit(0))) == len(quality_rules.RULES)


def test_rules_against_plain_verdicts(docs, odd):
    """``kept`` by all rules without a cascade."""
    def verdict(text):
        text = text or ""
        n, _, symbols, dup, repeated = base_measures(text)
        if n < 20 or 100 * repeated > 30 * n:
            return False
        words, upper, letters = WORD.findall(text), sum(c.isupper() for c in text), sum(c.isalpha() for c in text)
        chars, echo = sum(map(len, words)), sum(a == b for a, b in zip(words, words[1:], strict=False))
        return not (
            symbols * 10 > n * 3 or (upper > 20 and upper * 2 > letters) or text.count("!") * 3 > n or chars < n * 2 or chars > n * 14 or (dup >= 4 and dup * 10 > len(text.split("\n")) * 6) or echo * 5 > n
        )

    clash = odd.selectExpr("*", "1 AS words", "2 AS n_words", "3 AS copy", "4 AS base_failed")
    for table in (docs, clash):
        want = sorted((r.doc_id is not None, r.doc_id or 0, verdict(r.text)) for r in table.collect())
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.kept) for r in quality_rules.judge(table).collect()) == want
        kept = quality_rules.keep(table)
        assert kept.columns == table.columns and sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [w[:2] for w in want if w[2]]


# --- 2 URL filter


def brute_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def test_urls(spark, sf_dir):
    urls = [None, "", "no scheme", "http://", "HTTP://A.B.Net/En/x?y#z", "x://h?a/b", "x://h#a", "http://a.example.net/en/1", "http://example.com/de", "http://example.com/de/", "http://xnet/", "http://a://b/c", "https://É.ORG/fr/é"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    for table in (pages, spark.read.parquet(f"{sf_dir}/pages.parquet")):
        plain = {r.page_id: r.url for r in table.collect()}
        for r in url_filter.judge(table).collect():
            host, path = brute_url(plain[r.page_id])
            assert (r.host, r.path) == (host, path)
            fits = [x for x, _ in url_filter.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
            assert r.rule == (max(fits, key=len) if fits else None)
            by_model = "block" if host and r.score >= url_filter.BLOCK_AT else "allow"
            assert r.verdict == (dict(url_filter.RULES)[r.rule] if fits else by_model)


# --- 3 HTML


def test_html():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><nav><a href=/>home</a></nav><div class="ad">buy</div><!-- x -->'
        '<article><h1>Head &amp; line</h1><p><b>First\n  part.<br><p>Second &lt;b&gt; &eacute;</p><ul><li>one<li>two</ul><aside>side</aside><form>f</form><div class="cookie-notice">c</div>'
        '<div id="comments"><p>nice post</p></div></article><footer>&copy; me</footer></body></html>'
    )
    assert html_extract.main_text(page) == "Head & line\n\nFirst part.\n\nSecond <b> é\n\none\n\ntwo"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<html><body></body></html>") == ""
    assert html_extract.main_text("plain  text") == "plain text"
    assert html_extract.main_text("<p>" + "long text " * 50_000).count("long") == 50_000
    assert html_extract.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert html_extract.main_text('<body><div><p>' + "one two three " * 20 + '</p></div><div><p>' + "four five six " * 20 + '</p></div><div><a href=x>a</a> <a href=y>b</a></div></body>').count("\n\n") == 1


def test_html_wrappers_named_like_boilerplate():
    text = [" ".join(f"{w}{i}" for i in range(60)) for w in ("one", "two", "three")]
    body = "".join(f"<p>{x}</p>" for x in text)
    want = "\n\n".join(text)
    nav, talk = '<div class="sidebar"><a href=a>more</a> side</div>', '<div id="comments">' + "".join(f"<p>{'nice post ' * 30}</p>" for _ in range(9)) + "</div>"
    for wrapped in (
        f"<div class='layout has-sidebar'><article>{body}</article>{nav}</div>", f"<div class='sidebar'><article>{body}</article></div>",
        f"<div id='content' class='no-sidebar'>{body}</div>{nav}", f"<div class='post comments-open'>{body}</div>", f"<section class='related-work'>{body}</section>",
        f"<main><div class='has-sidebar'>{body}</div></main>", f"<main><div class='sidebar'><article>{body}</article></div></main>", f"<div class='post comments-open'>{body}</div>{talk}",
        f"<article>{body}{talk}</article>", f"<article>{body}</article>{talk}", f"<div class='layout has-sidebar'><article>{body}</article>{talk}</div>",
    ):
        assert html_extract.main_text(f"<html><body>{wrapped}</body></html>") == want, wrapped[:60]
    assert html_extract.main_text("<body><div class=ad>buy now</div></body>") == ""


def test_html_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        plain = [" ".join(html_extract.html_lib.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert rows[p.page_id].text == "\n\n".join(x for x in plain if x)
        assert rows[p.page_id].n_chars == len(rows[p.page_id].text)


# --- 4 near duplicates


def brute_groups(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)], least[find(k)] == i) for k, (i, s) in enumerate(sets))


def test_near_duplicates(docs):
    assert sorted(tuple(r) for r in near_dup.near_duplicates(docs).collect()) == brute_groups([(r.doc_id, r.text) for r in docs.collect()])


def test_near_duplicates_edges(spark, odd):
    rows = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dup.near_duplicates(odd).collect()}
    assert rows[(1, 0)] == (1, True) and rows[(2, 0)] == (2, True)
    assert rows[(4, 1)] == (4, True) and rows[(5, 1)] == (4, False)
    assert rows[(None, 4)] == (None, True)
    assert near_dup.near_duplicates(odd).count() == len(ODD)
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_large_group(spark, monkeypatch):
    """Edited copies around the threshold, with buckets beyond the small size."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for k in range(160):
        words = list(base)
        for p in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            words[p] = f"e{k}_{p}"
        rows.append((k, " ".join(words)))
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", 8)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dup.near_duplicates(table).collect()) == brute_groups(rows)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    off = []
    for share in (0.2, 0.5, 0.8):
        k = int(400 * 2 * share / (1 + share))
        b = np.concatenate([a[:k], rng.integers(0, 2**63, 400 - k).astype(np.uint64)])
        sig = near_dup.signatures([a, b])
        off.append(abs((sig[0] == sig[1]).mean() - k / (800 - k)))
    assert max(off) < 0.15
    assert (near_dup.signatures([a])[0] >> 24).max() <= 3  # stopped early


def test_superminhash_varies_less_than_minhash():
    """Small sets: the slots of one permutation are nearly a sample without repeats."""
    rng = np.random.default_rng(2)
    found = []
    for _ in range(500):
        x = rng.integers(0, 2**63, 45).astype(np.uint64)
        sig = near_dup.signatures([x[:30], x[15:]])
        found.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(found) - 1 / 3) < 0.01
    assert np.var(found) < 0.85 * (1 / 3 * 2 / 3 / near_dup.SLOTS)


def test_sketches_and_bands_lose_no_linked_pair():
    """4000 pairs between 0.75 and 0.8, the hardest that must be linked."""
    rng = np.random.default_rng(12)
    sets = []
    for _ in range(4000):
        n = int(rng.integers(40, 300))
        shared = int(np.ceil(rng.uniform(0.75, 0.8) * 2 * n / (1 + 0.75)))
        x = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
        sets += [x[:n], np.concatenate([x[:shared], x[n:]])]
    sig = near_dup.signatures(sets)
    keys, sk = near_dup.band_keys(sig), near_dup.sketches(sig).view(np.uint64)
    assert (keys[::2] == keys[1::2]).any(axis=1).all()
    x = sk[::2] ^ sk[1::2]
    off = np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x1555555555555555)).sum(axis=1)
    assert off.max() <= int(0.4 * 124)


# --- 6 token counts


def test_token_counts(docs, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.default_vocabulary())
    for table in (docs, odd):
        got = sorted(tuple(r)[1:3] for r in token_counts.count_tokens(table).collect())
        want = sorted((len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in table.collect())
        assert got == want


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(token_counts.default_vocabulary())


TEXTS = (
    "Hello there, it's   2024!\n\n  Ünïcode wörds. we'll they've I'd 'x ''re", "naïve \U0001f600 <|endoftext|> z!<|endoftext|><|endoftext|>  \n", "a" * 60, "qzxv" * 30, "     \n\n\n   12345678901234567890   x\t\ty  ",
    "!!!!??...;;;  ---   ", "", " ", "漢字 かな  ひらがな​ ẞß", "tokenization antidisestablishmentarianism internationalization  returns", "<|endof", "x <|endoftext|", "\xa0\x85 \u2003\u2003 a\u2003 b",
)


def test_every_prefix_is_exact(counter, docs):
    """The table of a text against the library's count of each of its prefixes."""
    rng = np.random.default_rng(3)
    some = [r.text for r in docs.orderBy("doc_id").limit(6).collect() if r.text]
    mixed = ["".join(rng.choice(list("  \n\t'abesrtTHE19!?.-éß漢"), 80)) for _ in range(40)]
    for text in (*TEXTS, *(t[:300] for t in some), *mixed):
        want = [len(counter.tokenizer.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
        assert counter.table(text).tolist() == want, text
        assert counter.count(text) == (want[-1] if want else 0)
        for budget in {0, 1, 2, 5, 17, len(want) // 4, counter.count(text)}:
            best = max((k for k, n in enumerate(want, 1) if n <= budget), default=0)
            assert counter.cut(text, budget) == best, (text, budget)


def test_stored_tables(spark, odd, counter):
    rows = token_counts.count_tokens(odd.filter("n_chars < 100 or n_chars is null"), limit=7, tables=True)
    for r in rows.select("*", token_counts.prefix_within("prefix_tokens", 7).alias("w"), token_counts.prefix_within("prefix_tokens", 0).alias("zero")).collect():
        assert r.w == r.cut_chars and r.zero == 0 and (r.prefix_tokens[-1] if r.prefix_tokens else 0) == r.n_tokens


def test_long_piece_is_cut_inside(counter):
    text = "qzxv" * 5000
    k = counter.cut(text, 512)
    assert len(counter.tokenizer.encode(text[:k], add_special_tokens=False).ids) <= 512 < len(counter.tokenizer.encode(text[: k + 1], add_special_tokens=False).ids)


def test_counts_come_from_prefixes(docs, monkeypatch):
    """Without the library's encoder, and in chunks of any size: totals and cuts are read from the prefixes."""
    from types import SimpleNamespace

    own = token_counts.PrefixCounter(token_counts.default_vocabulary())
    library, texts = own.tokenizer, [*TEXTS, *(r.text or "" for r in docs.orderBy("doc_id").limit(200).collect())]
    want = [len(library.encode(text, add_special_tokens=False).ids) for text in texts]
    own.tokenizer = SimpleNamespace(pre_tokenizer=library.pre_tokenizer)
    whole = [(*own.measure(text, 40), own.table(text).tolist()) for text in texts]
    assert [n for n, _, _ in whole] == want and all(cut == max((k for k, c in enumerate(table, 1) if c <= 40), default=0) for _, cut, table in whole)
    monkeypatch.setattr(token_counts, "CHUNK", 7)
    assert [(*own.measure(text, 40), own.table(text).tolist()) for text in texts] == whole


def test_vocabulary_of_another_form(odd):
    """Split otherwise than by this module's pattern: counted by the library, as its own file says."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    assert not own.plain
    for text in TEXTS:
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert own.count(text) == n and own.cut(text, n) == len(text) and (not n or own.cut(text, n - 1) == -1)


# --- 7 mixing


def brute_targets(sizes, weights):
    budget, free, out = 1.5 * sum(sizes.values()), dict(sizes), {}
    while True:
        total = sum(weights[s] for s in free)
        over = [s for s in free if budget * weights[s] / total > 2 * free[s]]
        if not over:
            return out | {s: budget * weights[s] / total if total else 0.0 for s in free}
        for s in over:
            out[s] = 2.0 * free.pop(s)
            budget -= out[s]


def check_mix(table):
    rows = mixing.mix(table).collect()
    source = {}
    for r in table.collect():
        source.setdefault(r.doc_id, r.source)
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_targets({s: sizes[s] for s in order}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for s in order:
        assert target[s] == pytest.approx(want[s]) and all(r.source_size == sizes[s] for r in rows if source[r.doc_id] == s)
    return {s: (taken[s], target[s]) for s in order}, sorted((r.doc_id or 0, r.taken) for r in rows)


def test_mixing(docs, odd):
    near, first = check_mix(docs)
    for taken, target in near.values():
        assert abs(taken - target) <= max(60, 0.02 * target)
    assert check_mix(docs)[1] == first
    assert len(check_mix(odd)[1]) == len(ODD)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_knapsack_is_exact():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = sorted(set(rng.integers(1, 30, 5).tolist()))
        counts = rng.integers(0, 4, len(lengths)).tolist()
        budget = int(rng.integers(0, 90))
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        take = mixing.knapsack(lengths, counts, budget)
        assert all(t <= c for t, c in zip(take, counts, strict=True))
        assert sum(n * t for n, t in zip(lengths, take, strict=True)) == max(s for s in sums if s <= budget)
        take = mixing.knapsack(lengths, counts, budget, budget)
        assert all(t <= c for t, c in zip(take, counts, strict=True))
        assert abs(sum(n * t for n, t in zip(lengths, take, strict=True)) - budget) == min(abs(s - budget) for s in sums)


# --- 9 decontamination


def weighted(a, b):
    shared = sum((a & b).values())
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


def brute_leaks(rows, items):
    found = set()
    for doc_id, text in rows:
        words = lower_words(text)
        own = shingle_row(words, WordHashes()).tolist()
        for item_id, item in items:
            theirs = shingle_row(lower_words(item), WordHashes()).tolist()
            if not own or not theirs or not set(own) & set(theirs):
                continue
            span = min(len(theirs), len(own))
            for start in range(len(own) - span + 1):
                if weighted(Counter(own[start : start + span]), Counter(theirs)) >= 0.75:
                    found.add((doc_id, item_id))
                    break
    return found


def test_leaks(spark, sf_dir, odd):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain = [(r.item_id, r.text) for r in items.collect()]
    # edited passages too
    words = plain[0][1].split()
    edited = spark.createDataFrame([(10_001, "q " * 30 + " ".join(words[:9] + ["zz"] + words[9:]) + " r" * 30), (10_002, " ".join(words[:8])), (10_003, plain[1][1].upper())], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(edited)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, items).collect()}
    assert got == brute_leaks([(r.doc_id, r.text) for r in table.collect()], plain) and (10_003, plain[1][0]) in got
    assert decontaminate.leaks(odd, items.limit(0)).count() == 0 == decontaminate.leaks(odd.limit(0), items).count()
    blank = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e f g h")], "item_id long, text string")
    assert decontaminate.leaks(odd, blank).count() == 0


def test_leaks_of_repeated_items_and_blocks(spark, monkeypatch):
    """Items that share an id are one item with several texts; blocks do not change the rows; ids of other types."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 5000, 30)) for _ in range(12)]
    items = [(k // 2, t) for k, t in enumerate(texts)] + [(0, texts[0]), (0, texts[0]), (None, texts[1]), (3, None)]
    docs = [(k, f"{'a b c ' * 9}{t} {'d e f ' * 9}") for k, t in enumerate(texts)] + [(50, texts[0] + " " + texts[1]), (None, texts[5]), (4, texts[9])]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS similarity", "3 AS start_word")
    want = sorted([(k, k // 2) for k in range(12)] + [(50, 0), (4, 4)]) + [(None, 2)]
    for block, kind in ((20_000, "long"), (1, "long"), (3, "string")):
        monkeypatch.setattr(decontaminate, "ITEM_BLOCK", block)
        bench = spark.createDataFrame(items, "item_id long, text string").selectExpr(f"CAST(item_id AS {kind}) AS item_id", "text", "'x' AS doc_id")
        got = [(r.doc_id, r.item_id) for r in decontaminate.leaks(table, bench).collect()]
        assert sorted(x for x in got if x[0] is not None) + [x for x in got if x[0] is None] == want


def test_long_texts_in_pieces(monkeypatch):
    from lodeline.llm import words

    rng = np.random.default_rng(5)
    text = " ".join(f"w{x}\u00a0é" for x in rng.integers(0, 900, 4000)) + "\n\t end"
    whole = shingle_row(lower_words(text), WordHashes())
    for size in (1, 7, 1000):
        monkeypatch.setattr(words, "PIECE_BYTES", size)
        assert np.array_equal(words.shingles_of(words.word_row(text, WordHashes())), whole)
    starts = np.sort(rng.choice(3900, 500, replace=False))
    prints = decontaminate.fingerprints(whole, starts, 60)
    for chunk in (1, 50, 997):
        monkeypatch.setattr(decontaminate, "CHUNK", chunk)
        assert np.array_equal(decontaminate.fingerprints(whole, starts, 60), prints)
    for at, print_ in zip(starts[:40].tolist(), prints[:40].tolist(), strict=True):
        bits = [(sum(1 if x >> b & 1 else -1 for x in whole[at : at + 60].tolist()) > 0) << b for b in range(64)]
        assert sum(bits) == print_


def test_fingerprints_find_edited_passages():
    """Passages of 20 to 120 words with words put in, dropped and replaced, all windows, no bound on shared shingles: the
    Hamming blocks alone hand over nearly every pair at 0.75 or more, and few of those that share next to nothing."""
    rng, hashes = np.random.default_rng(7), WordHashes()
    met = wanted = other = handed = 0
    for k in range(700):
        words = [f"t{x}" for x in rng.integers(0, 3000, int(rng.integers(20, 120)))]
        index = decontaminate.ItemIndex.of([(k, " ".join(words))])
        width = next(iter(index.tables))
        edited = list(words)
        for _ in range(int(rng.integers(0, 1 + len(words) // 12))):
            at, kind = int(rng.integers(0, len(edited))), int(rng.integers(0, 3))
            edited[at : at + (kind < 2)] = [f"e{at}"] * (kind != 1)
        text = [f"f{x}" for x in rng.integers(0, 3000, 15)] + edited + [f"g{x}" for x in rng.integers(0, 3000, 15)]
        row = shingle_row([w.encode() for w in text], hashes)
        starts = np.arange(max(0, len(row) - width + 1))
        for start, print_ in zip(starts.tolist(), decontaminate.fingerprints(row, starts, width).tolist(), strict=True):
            near = bool(index.candidates(width, print_))
            similarity = decontaminate.weighted_similarity(decontaminate.shape(row[start : start + width]), index.shapes[0])
            if similarity >= decontaminate.THRESHOLD:
                wanted, met = wanted + 1, met + near
            elif similarity < 0.1:
                other, handed = other + 1, handed + near
    assert wanted > 1000 and met >= 0.995 * wanted and handed < 0.1 * other


def test_blocks_guarantee_the_radius():
    rng = np.random.default_rng(2)
    text = " ".join(f"w{i}" for i in range(40))
    index = decontaminate.ItemIndex.of([(1, text)])
    width = next(iter(index.tables))
    for _ in range(300):
        flips = rng.choice(64, int(rng.integers(0, decontaminate.RADIUS + 1)), replace=False)
        print_ = index.prints[0]
        for b in flips.tolist():
            print_ ^= 1 << b
        assert index.candidates(width, print_) == [0]


# --- 10 chat


def test_chat(spark):
    turns = [(1, 1, "bob", "hi"), (1, 0, "system", "S"), (1, 2, "amy", "yo"), (1, 3, "bob", None), (2, 0, "system", "only"), (3, None, None, "x"), (3, 1, "bob", "y"), (None, 0, "bob", "z")]
    rows = {(r.conv_id, r.perspective): r for r in chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(rows) == {(1, "amy"), (1, "bob"), (3, "bob"), (3, "unknown"), (None, "bob")}
    bob = rows[(1, "bob")]
    assert bob.text == "<|system|>\nS<|end|>\n<|assistant|>\nhi<|end|>\n<|user:amy|>\nyo<|end|>\n<|assistant|>\n<|end|>\n"
    assert [bob.text[m.start : m.end] for m in bob.masks] == ["hi<|end|>", "<|end|>"]
    assert bob.n_masked == sum(m.end - m.start for m in bob.masks)


TURNS = "conv_id long, turn long, role string, text string"


def brute_chat(turns, part_turns):
    """(conv_id, perspective, part): text and masked texts."""
    def escaped(x, name=False):
        x = re.sub(r"<(\\*)\|", r"<\\\1|", x)
        return re.sub(r"\|(\\*)>", r"|\\\1>", x) if name else x

    found = {}
    turns = [(c, t, "unknown" if r is None else r, x or "") for c, t, r, x in turns]
    for c in {t[0] for t in turns}:
        order = sorted((t for t in turns if t[0] == c), key=lambda t: (t[2] != "system", t[1] is not None, t[1] or 0, t[2], t[3]))
        for who in {t[2] for t in order} - {"system"}:
            for k in range(0, len(order), part_turns):
                heads = {"system": "<|system|>", who: "<|assistant|>"}
                own = order[k : k + part_turns]
                whole = "".join(f"{heads.get(r) or '<|user:' + escaped(r, True) + '|>'}\n{escaped(x)}<|end|>\n" for _, _, r, x in own)
                found[(c, who, k // part_turns)] = (whole, [escaped(x) + "<|end|>" for _, _, r, x in own if r == who])
    return found


def chat_rows(table, *args):
    return {(r.conv_id, r.perspective, r.part): (r.text, [r.text[m.start : m.end] for m in r.masks]) for r in chat.rotate(table, *args).collect()}


def test_chat_dialogues_stay_whole(spark):
    """600 turns, 600 equal turn numbers, and marks inside texts and names; one row for each participant."""
    turns = [(c, t, "system" if t == -1 else "ab"[t % 2], f"t{t}") for c in (1, None) for t in range(-1, 600)]
    turns += [(2, 7, "abc"[k % 3], f"x{k}") for k in range(600)] + [(2, None, "a", "none"), (2, 7, "a", "x0"), (3, 0, "e|>v<|il", "a<|end|>\n<|assistant|>\nb<\\|c"), (3, 1, "b", "|> <| <\\\\|")]
    got = chat_rows(spark.createDataFrame(turns, TURNS))
    assert got == brute_chat(turns, chat.PART_TURNS)
    assert {k[2] for k in got} == {0}
    text = got[(3, "b", 0)][0]
    assert text.count("<|end|>") == 2 and text.count("<|assistant|>") == 1
    assert re.sub(r"<\\(\\*)\|", r"<\1|", text.split("\n", 1)[1].split("<|end|>\n<|assistant|>")[0]) == "a<|end|>\n<|assistant|>\nb<\\|c"


def test_chat_parts_of_unbounded_dialogues(spark):
    turns = [(c, t, "system" if t == 900 else "ab"[t % 2], f"t{t}") for c in (1, None) for t in range(1000)]
    turns += [(1, 5, "b", "again")] * 700 + [(1, None, "a", "none"), (2, 700, "a", "late"), (2, 3, "b", "early")]
    table = spark.createDataFrame(turns, TURNS)
    assert chat_rows(table, 256) == brute_chat(turns, 256)
    assert chat.rotate(table.limit(0)).count() == 0


def test_chat_sql(spark, tmp_path):
    import duckdb

    from lodeline.llm.oracles import CHAT_SQL

    turns = [(c, t, "system" if t == 900 else "ab"[t % 2], f"t{t} <|end|> <\\|") for c in (1, None) for t in range(700)] + [(2, 1, "x|>", "y"), (2, None, None, None)]
    spark.createDataFrame(turns, TURNS).coalesce(1).write.parquet(str(tmp_path / "c"))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
        want = sorted(map(repr, db.sql(f"SELECT conv_id, perspective, part, n_turns, text, masks, n_masked FROM ({CHAT_SQL})").fetchall()))
    rows = chat.rotate(spark.createDataFrame(turns, TURNS)).selectExpr("conv_id", "perspective", "part", "n_turns", "text", "transform(masks, m -> concat_ws('-', m.start, m.end)) AS masks", "n_masked")
    assert sorted(repr(tuple(r)) for r in rows.collect()) == want


# --- all


def test_queries_run_over_whole_tables(spark, sf_dir):
    found = llm_queries.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in found) == list(range(1, 11))
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op1_quality_rules", "op4_near_dup", "op5_quality_model", "op6_token_counts", "op7_mixing"):
        assert found[name](spark, sf_dir).count() == n
