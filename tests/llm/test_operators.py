"""Each operator against brute force or a round trip, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import html
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from accrete.llm import chat_format, components, decontamination, html_text, line_dedup, near_dedup, quality_rules, secret_scan, substring_dedup, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANDOM = random.Random(5)
VOCABULARY = ["".join(RANDOM.choice("abcdefghij") for _ in range(RANDOM.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, n, seed):
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def docs(spark):
    base, passage = prose(120, 1), prose(60, 2)
    texts = [None, "", " \n ", "one", base, base, edited(base, 2, 3), edited(base, 4, 4), base.upper(), prose(90, 5) + " " + passage, passage + "\n" + prose(30, 6), prose(20, 7) + " " + passage[:200], "spam " * 60, "a a", "A  a", prose(4000, 8), edited(prose(4000, 8), 60, 9), prose(49, 10), prose(49, 10), prose(50, 11), prose(50, 11)]
    texts += [f"{prose(25, 100 + i)}\n{edited(prose(40, 99), 1, i)}\n{prose(25, 200 + i)}" for i in range(12)]
    rows = [(i, t, ["en", "de", None, "xx"][i % 4], "s", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, keys long")


def texts_of(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_quality_counts(spark, docs):
    labels = spark.createDataFrame([(4, 1, 0), (12, 0, 0), (12, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    for doc_id, text in texts_of(docs).items():
        w = WORD.findall(text)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(k, k + 8)} if len(w) < 500 else set()
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    kept = quality_rules.keep_good(docs.withColumn("n_words", F.lit("mine")), labels)
    assert kept.columns == [*docs.columns, "n_words"]
    assert {r["n_words"] for r in kept.collect()} == {"mine"}
    assert quality_rules.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_binomial_tail(spark):
    from math import comb

    rows = spark.createDataFrame([(k, n) for n in (1, 40, 500) for k in (0, 1, 7) if k <= n], "k long, n long")
    for r in rows.withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.05)).collect():
        exact = sum(comb(r["n"], i) * 0.05**i * 0.95 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["p"] == pytest.approx(1.0 if r["k"] >= 0.05 * r["n"] else exact, rel=1e-9)


def test_cutoffs_limit_false_rejections(spark):
    r = random.Random(3)
    rows = [(i, prose(40, i) if i % 5 else " ".join(w + "$$$" for w in prose(40, i).split()), "en") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(6000) if r.random() < 0.9], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(docs, labels).select("doc_id", "kept").collect()
    assert all(x["kept"] == (x["doc_id"] % 5 > 0) for x in got)


def jaccard_components(items, sets, alike):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(items, 2):
        if sets[a] and sets[b] and alike(len(sets[a] & sets[b]), len(sets[a] | sets[b])):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def test_near_dedup(spark, docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc_id, text in texts_of(docs).items():
        w = WORD.findall(text.translate(lower))
        sets[doc_id] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    expected = jaccard_components(sorted(sets), sets, lambda i, u: 100 * i >= 80 * u)
    got = near_dedup.groups(docs, size=4, percent=80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), expected[i]) for i in sets}
    kept = near_dedup.keep_first(docs.unionAll(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
    assert kept.columns == docs.columns
    assert kept.where("doc_id is null").count() == 1
    assert near_dedup.groups(docs.limit(0)).count() == 0


def test_large_buckets_are_exact(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 4)
    # near copies of one document, and small groups that lie further from it than from each other
    texts = [edited(prose(100, 50), k % 4, k) for k in range(30)]
    for k in range(12):
        far = edited(prose(100, 50), 5, 700 + k)
        texts += [far, edited(far, 1, 800 + k)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(97)} for i, t in enumerate(texts)}
    expected = jaccard_components(range(54), sets, lambda i, u: 100 * i >= 80 * u)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.groups(docs, 4, 80).collect()} == expected


def test_repeated_ids_keep_their_own_texts(spark):
    one, two = prose(80, 60), prose(80, 61)
    rows = [(1, one), (1, two), (2, edited(two, 1, 5)), (3, edited(one, 1, 6)), (3, edited(one, 1, 6)), (4, None)]
    got = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (4, 4)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}


def test_substring_dedup(spark, docs):
    texts, first = texts_of(docs), {}
    words = {i: WORD.findall(t) for i, t in sorted(texts.items())}
    for i, w in words.items():
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    got = {r["doc_id"]: r for r in substring_dedup.remove(docs.withColumn("kept", F.lit(1))).collect()}
    removed = 0
    for i, w in words.items():
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        removed += len(gone)
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), len(gone))
        assert got[i]["kept"] == " ".join(x for j, x in enumerate(w) if j not in gone)
    assert removed > 200
    assert substring_dedup.remove(docs.limit(0)).count() == 0


def test_suffix_automaton():
    r = random.Random(1)
    for _ in range(50):
        ref, text = [r.randrange(3) for _ in range(30)], [r.randrange(3) for _ in range(40)]
        runs = {tuple(ref[i : i + 4]) for i in range(27)}
        covered = {j for k in range(37) if tuple(text[k : k + 4]) in runs for j in range(k, k + 4)}
        spans = substring_dedup.SuffixAutomaton(ref).spans(text, 4)
        assert {j for a, b in spans for j in range(a, b)} == covered


def test_line_dedup(spark, docs):
    docs = docs.withColumn("n_chars", F.length("text")).withColumn("doc", F.lit("mine"))
    space = " \t\n\x0b\x0c\r"
    places = {}
    for i, t in sorted(texts_of(docs).items()):
        for k, x in enumerate(t.split("\n")):
            if x.strip(space):
                places.setdefault(x.strip(space), []).append((i, k))
    lines = sorted(places)
    sets = {n: {x[k : k + 9] for k in range(max(1, len(x) - 8))} for n, x in enumerate(lines)}
    root = jaccard_components(range(len(lines)), sets, lambda i, u: i >= 0.8 * u)
    kept = {}
    for n, x in enumerate(lines):
        kept[root[n]] = min([kept.get(root[n], (10**9, 0)), *places[x]])
    stays = set(kept.values())
    got = line_dedup.dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    for r in got.collect():
        assert r["doc"] == "mine"
        if r["doc_id"] == 0:
            assert r["text"] is None
            continue
        original = texts_of(docs)[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(x for k, x in enumerate(original) if not x.strip(space) or (r["doc_id"], k) in stays)
        assert r["n_chars"] == len(r["text"])
        assert r["n_removed"] == len(original) - len([x for k, x in enumerate(original) if not x.strip(space) or (r["doc_id"], k) in stays])
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_line_dedup_without_spaces(spark):
    """Against the shingles of every character."""
    r = random.Random(9)
    rows, gone = [], set()
    alphabets = {"chinese": [chr(0x4E00 + i) for i in range(3000)], "encoded": list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"), "emoji": [chr(0x1F300 + i) for i in range(300)]}
    for name, letters in alphabets.items():
        for n in (80, 300):
            line = [r.choice(letters) for _ in range(n)]
            near, far = list(line), list(line)
            near[n // 2] = "x"  # 0.78 for 80 characters, 0.94 for 300
            for i in range(0, n, 10):
                far[i] = "x"
            rows += [(f"{name} {n} 0", "".join(line)), (f"{name} {n} 1", "".join(near)), (f"{name} {n} 2", "".join(far))]
            gone |= {f"{name} {n} 1"} if n == 300 else set()
    rows += [("short 0", "abcdefgh"), ("short 1", "abcdefgi"), ("short 2", "abcdefghi"), ("short 3", "abcdefghij")]
    texts = dict(rows)
    sets = {i: {t[k : k + 9] for k in range(max(1, len(t) - 8))} for i, t in rows}
    root = jaccard_components(sorted(texts), sets, lambda i, u: i >= 0.8 * u)
    assert {i for i in texts if root[i] != i} == gone
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {x["doc_id"] for x in got if x["n_removed"]} == gone
    known = spark.createDataFrame([(t,) for t in texts.values()], "line string").select("line", F.size(line_dedup.shingles(F.col("line"))).alias("n")).collect()
    assert {x["line"]: x["n"] for x in known} == {texts[i]: len(s) for i, s in sets.items()}


def removed_lines(spark, lines, dense=False):
    """The lines that go, by the operator and by brute force over full character shingles; each line is a document. dense: most lines share shingles."""
    sets = {i: {x[k : k + 9] for k in range(max(1, len(x) - 8))} for i, x in enumerate(lines)}
    if dense:
        column = {g: k for k, g in enumerate(sorted(set().union(*sets.values())))}
        has = np.zeros((len(sets), len(column)), np.float32)
        for i, s in sets.items():
            has[i, [column[g] for g in s]] = 1
        common = has @ has.T
        pairs = {(j, i): common[j, i] for i in sets for j in range(i)}
    else:
        holds, pairs = {}, {}
        for i, s in sets.items():
            for g in s:
                for j in holds.setdefault(g, []):
                    pairs[j, i] = pairs.get((j, i), 0) + 1
                holds[g].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (j, i), n in pairs.items():
        if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    got = line_dedup.dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("n_removed > 0").select("doc_id").collect()
    return {r["doc_id"] for r in got}, {i for i in sets if find(i) != i}


def template_lines(near, count):
    """Lines of 60 words that share 40, with 3 variants in each of the other 20 places, near lines of each choice."""
    r = random.Random(7 + near)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(11))
    template, lines = [word() for _ in range(60)], []
    slots = r.sample(range(60), 20)
    variants = {s: [word() for _ in range(3)] for s in slots}
    for _ in range(count):
        mine = {s: r.choice(variants[s]) for s in slots}
        for k in range(near):
            if k:
                mine[r.choice(slots)] = word()
            lines.append(" ".join(mine.get(i, w) for i, w in enumerate(template)))
    r.shuffle(lines)
    return lines


@pytest.mark.parametrize("near", [1, 4])
def test_template_lines(spark, near):
    """Large buckets hold many small groups of alike lines."""
    got, expected = removed_lines(spark, template_lines(near, 200 if near == 1 else 75))
    assert got == expected
    assert len(expected) >= (1 if near == 1 else 150)


@pytest.mark.parametrize("near, count, least", [(1, 1500, 20), (4, 375, 1000)])
def test_many_template_lines(spark, near, count, least):
    """1,500 lines of one template: buckets that stay large after the finer bands are compared in blocks, and no link is lost."""
    got, expected = removed_lines(spark, template_lines(near, count), dense=True)
    assert got == expected
    assert len(expected) >= least


def test_blocks_of_small_size(spark, monkeypatch):
    """Many blocks a bucket give what one block gives."""
    monkeypatch.setattr(line_dedup, "BLOCK", 5)
    got, expected = removed_lines(spark, template_lines(1, 300), dense=True)
    assert got == expected


def test_bitmaps(spark):
    """Each long holds the parities of the hashes between two points; sets that differ in few hashes differ in no more bits."""
    r, width = random.Random(13), (1 << 64) // line_dedup.LONGS
    sets = [[r.randrange(-(1 << 63), 1 << 63) for _ in range(n)] for n in (1, 2, 15, 300, 2000)]
    sets += [[-(1 << 63), 0, (1 << 63) - 1, -1], [-(1 << 63) + k * width for k in range(line_dedup.LONGS)], [64 * k for k in range(8)], sets[3][7:] + [5, 6]]
    got = {x["id"]: x for x in line_dedup.with_bitmap(spark.createDataFrame(list(enumerate(sets)), "id long, set array<long>")).collect()}
    for i, s in enumerate(sets):
        bits = [0] * line_dedup.LONGS
        for h in s:
            bits[(h + (1 << 63)) // width] ^= 1 << (h & 63)
        assert got[i]["n"] == len(s)
        assert [x % (1 << 64) for x in got[i]["bits"]] == bits
    apart = sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(got[3]["bits"], got[8]["bits"], strict=True))
    assert 0 < apart <= len(set(sets[3]) ^ set(sets[8]))


def test_line_recall(spark):
    """Lines of 4 to 90 words with edits spread out, about 0.8 to 0.95 alike: nearly all are found, and no others."""
    r, lines = random.Random(11), []
    for n in range(900):
        w = prose(4 + n % 87, 5000 + n)
        lines.append(w)
        for share in (0.012, 0.006):
            x = list(w)
            for _ in range(max(1, round(share * len(w)))):
                x[r.randrange(len(x))] = r.choice("xyz")
            lines.append("".join(x))
    got, expected = removed_lines(spark, lines)
    assert got <= expected
    assert len(expected) > 800
    assert len(got) >= 0.98 * len(expected), (len(got), len(expected))


def test_decontamination(spark):
    items = [(1, prose(40, 70)), (2, prose(15, 71)), (3, None), (4, "too few words"), (5, prose(59, 72)), (6, prose(40, 70))]
    one_off = prose(59, 72).split()
    one_off[20] = "other"
    texts = [None, "", prose(100, 73), prose(30, 74) + " " + items[0][1].upper() + ". " + prose(9, 75), items[1][1], prose(20, 76) + " " + " ".join(one_off), items[0][1][:80], prose(3000, 77) + " " + items[4][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit("x"))
    items = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"]) for r in decontamination.leaks(docs, items).collect()}
    assert got == {(3, 1): (30, 40), (3, 6): (30, 40), (4, 2): (0, 15), (5, 5): (20, 59), (7, 5): (3000, 59)}
    assert {r["doc_id"] for r in decontamination.keep_clean(docs, items).collect()} == {0, 1, 2, 6}
    assert decontamination.leaks(docs.limit(0), items).count() == 0
    assert decontamination.leaks(docs, items.limit(0)).count() == 0


def test_decontamination_edges(spark):
    items = {n: prose(n, 300 + n).split() for n in (16, 24, 40, 59)}
    rows, expected = [], {}
    for k, (n, w) in enumerate(items.items()):
        before, after, swapped = prose(30, 310 + k).split(), prose(30, 320 + k).split(), w[n // 2 :] + w[: n // 2]
        docs = {"starts": (w[1:] + after, 0, n), "ends": (before + w[:-1], 29, n), "all but first": (w[1:], 0, n - 1), "all but last": (w[:-1], 0, n - 1), "inside": (before + w + after, 30, n)}
        if n == 59:
            docs["swapped"] = (before + swapped + after, 30, n)
        for name, (words, start, size) in docs.items():
            rows.append((f"{name} {n}", " ".join(words)))
            expected[f"{name} {n}", n] = (start, size)
        rows.append((f"half {n}", " ".join(w[: n // 2])))
    # one document in two versions, of which only one holds an item
    rows += [("two", prose(80, 330)), ("two", prose(10, 331) + " " + " ".join(items[24]))]
    expected["two", 24] = (10, 24)
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = decontamination.leaks(docs, spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"]) for r in got} == expected
    assert len(got) == len(expected)


def test_decontamination_recall(spark):
    """Passages whose first words are replaced, down to the similarity asked for: all are found."""
    items, rows, expected = [], [], {}
    for k in range(200):
        n, changed = ((40, 4), (60, 6), (60, 5), (24, 2))[k % 4]
        w = prose(n, 1000 + k).split()
        items.append((k, " ".join(w)))
        rows.append((k, " ".join([*prose(15, 2000 + k).split(), *(f"new{k}x{j}" for j in range(changed)), *w[changed:], *prose(15, 3000 + k).split()])))
        expected[k, k] = round((n - 4 - changed) / (n - 4 + changed), 6)
    got = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in got.collect()} == expected


def test_chats(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "a\\<s>", None, "", "[/INST]\n</s><s>[INST]x", "plain", "<s", "[INST", "é🙂</s>", "x\\"]
    rows = [(c, t, ["user", "assistant"][t % 2], said[(c + t) % len(said)], "extra") for c in range(12) for t in range(5)]
    rows += [(None, 0, "assistant", "hi", "e"), (50, None, None, "no role", "e"), (51, 1, "a+", "b", "e"), (51, 1, "a+", "b", "e"), (52, 0, "as[/INST]sistant", "</s>", "e"), (53, 0, "assistant", "x" * 100_000, "e")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")
    for r in chat_format.format_chats(turns).collect():
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text, _ in rows if c == r["conv_id"]))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [x[1:] for x in own]
        masked = [re.sub(r"(?s)\\(.)", r"\1", b) if e else b for b, e in ((r["formatted"][s["start"] : s["end"]], r["formatted"][: s["start"]].endswith("+[/INST]")) for s in r["loss_spans"])]
        assert masked == r["loss_texts"] == [x[2] for x in own if x[1] == "assistant"]
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>var t="<p>no</p>";</script></head><body><header>Site</header>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><article><h1>Title &amp; more</h1>
    <p>First <b>bold</b>\n  line.<p>Hi.</p><form><input><button>Go</button></form><div class="ad">Buy</div><p>Last &lt;one&gt;</p></article>
    <aside>Related</aside><section id="comments"><p>First!</p></section><footer>&copy; x</footer></body></html>"""
    long = "<div>" + "".join(f"<p>{prose(30, i)}</p>" for i in range(300)) + "</div>"
    menu = "<div><a href='/'>a</a></div><div><a href='/b'>b</a></div>"
    rows = [(1, page), (2, None), (3, ""), (4, "<p>unclosed <b>text that is long enough to count as the main part of this page, surely"), (5, menu + long), (6, "no markup"), (7, "<nav>only</nav>"), (1, page)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, html string").withColumn("n_chars", F.lit("old"))).collect()
    by = {r["page_id"]: r["main_text"] for r in got}
    assert by[1] == "Title & more\nFirst bold line.\nHi.\nLast <one>"
    assert (by[2], by[3], by[7]) == ("", "", "")
    assert by[4].startswith("unclosed text")
    assert by[5] == "\n".join(prose(30, i) for i in range(300))
    assert len(got) == 8
    assert all(r["n_chars"] == len(r["main_text"]) for r in got)
    assert html.unescape("&amp;") == "&"


def test_secrets(spark):
    texts = [None, "", "token = abcdefghijklmnop and", "PASSWORD:'hunter2hunter2'", "token:secret: abcdefghijkl", "AKIA" + "A" * 14, "AKIA" + "A" * 13, "x deadbeefdeadbeef y", "deadbeefdeadbee", "api_key=AKIA" + "B" * 20, "apikey: " + "z" * 12, "ghp_" + "a1" * 18, "🙂 secret=" + "q" * 5000, "Kpassword=abcdefghijkl", "paſſword=abcdefghijkl"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.scan(docs.withColumn("spans", F.lit(1))).collect():
        text = r["text"] or ""
        expected = [(m.start(), k, m.end()) for k, (_, p, fold, g, least) in enumerate(secret_scan.RULES) for m in re.finditer(p, text, re.ASCII | (re.I if fold else 0)) if m.end(g) - m.start(g) >= least]
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"]] == [(a, secret_scan.RULES[k][0], b) for a, k, b in sorted(expected)]


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("[0-9a-f]+") is True
    assert q("AKIA[A-Z]+") == frozenset({frozenset({"aki", "kia"})})
    assert q("(?:abc|xyzt)+d?") == frozenset({frozenset({"abc"}), frozenset({"xyz", "yzt"})})
    assert q("a?b?c?") is True
    assert q("abc|d+") is True


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x?y"), (2, "https://b.net/x"), (3, "http://example.com/de/1"), (4, "x://w.example.org/fr/#t"), (5, None), (6, "nothing"), (7, "http://b.net"), (8, "http://bnet/x"), (9, ""), (10, "http://example.com/en/1?u=http://x.net/")]
    rows += [(100 + i, f"http://{'casino' if i % 4 == 0 else 'garden'}{chr(97 + i % 20)}.example.com/en/{i}") for i in range(400)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("score", F.lit("x"))).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert [got[i]["rule"] for i in range(2, 11)] == ["net/", "example.com/de/", "org/fr/", None, None, None, None, None, None]
    assert (got[5]["host"], got[5]["path"], got[5]["verdict"], got[6]["host"]) == ("", "", "allow", "")
    assert all(got[100 + i]["verdict"] == ("block" if i % 4 == 0 else "allow") for i in range(400))
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_models(spark):
    """Scores, threshold and verdicts against models built by loops."""
    from collections import Counter
    from math import ceil, log

    r = random.Random(21)
    tops, langs, names = ["net", "org", "com"], ["en", "de", "fr"], ["garden", "recipes", "casino", "news", "xxxnews", "bnet"]
    rows = [(i, f"http{'s' if i % 3 else ''}://{r.choice(['www.', 'm.', ''])}{r.choice(names)}{r.choice('abc')}.example.{r.choice(tops)}/{r.choice(langs)}/{r.randrange(200)}{r.choice(['', '/x', '?a=1'])}") for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)] + [(3000, "http://" + "long" * 5000 + ".example.com/" + "p" * 20_000), (3001, None), (3002, "")]
    got = {x["page_id"]: x for x in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), keep=0.9).collect()}
    spelt = {i: re.sub("[0-9]+", "0", x["host"] + x["path"]) for i, x in got.items()}
    bad = {i: x["rule"] in ("net/", "example.com/de/") or any(s in x["host"] for s in url_filter.SEEDS) for i, x in got.items()}
    distinct = sorted({s for s in spelt.values() if s})
    hashes = spark.createDataFrame([(s,) for s in distinct], "s string").select("s", (F.pmod(F.xxhash64("s"), F.lit(url_filter.HELD_OUT)) == 0).alias("held")).collect()
    held = {x["s"]: x["held"] for x in hashes}
    seen = {k: [Counter(), Counter()] for k in range(5)}
    grams = lambda s: [("\x02" * 3 + s)[i : i + 4] for i in range(len(s))]
    for i, s in spelt.items():
        if s and not held[s]:
            for g in grams(s):
                for k in range(5):
                    seen[k][bad[i]][g[4 - k :]] += 1
                    if k:
                        seen[k][bad[i]]["before", g[4 - k : -1]] += 1

    def chance(g, c):
        p = 1 / 96
        for k in range(1, 5):
            p = (seen[k][c][g[4 - k :]] + 4 * p) / (seen[k][c]["before", g[4 - k : -1]] + 4)
        return p

    known = {}
    score = {}
    for s in distinct:
        for g in grams(s):
            known.setdefault(g, log(chance(g, 1)) - log(chance(g, 0)))
        score[s] = sum(known[g] for g in grams(s)) / len(s)
    calm = sorted(score[spelt[i]] for i in spelt if spelt[i] and held[spelt[i]] and not bad[i])
    line = max(0, ceil(calm[ceil(0.9 * len(calm)) - 1] / 1e-4) * 1e-4)
    for i, x in got.items():
        if not spelt[i]:
            assert (x["score"], x["verdict"]) == (None, "allow")
            continue
        assert x["score"] == pytest.approx(score[spelt[i]], abs=1e-9)
        if x["rule"] is None:
            assert x["verdict"] == ("block" if score[spelt[i]] > line else "allow")
    assert len({x["verdict"] for x in got.values() if x["rule"] is None}) == 2


def test_html_without_article(spark):
    """What the distribution of text alone decides, and pages that are hostile or hold teasers as articles."""
    main = html_text.main_text
    text = lambda n, seed: prose(n, seed)
    assert main(f"<div>{text(60, 1)}</div><div>Short one.</div><div>{text(60, 2)}</div>") == f"{text(60, 1)}\nShort one.\n{text(60, 2)}"
    menu = "".join(f"<div><a href='/{i}'>entry {i}</a></div>" for i in range(5))
    assert main(f"{menu}<div>{text(60, 3)}</div>{menu}<div>tail</div>") == text(60, 3)
    teasers = "".join(f"<article>{text(3, i)}</article>" for i in range(3))
    assert text(200, 9) in main(f"<div>{text(200, 9)}</div>{teasers}")
    ads = "<div class='ad'>Buy</div>"
    assert main(f"<p>outside</p><article><h1>T</h1>{ads}<p>{text(80, 4)}</p>{ads}{ads}<p>End.</p></article><p>outside</p>") == f"T\n{text(80, 4)}\nEnd."
    for hostile in ("<a x" * 250_000, "<!" * 500_000, "<!-- " * 200_000, "<p>hi " + "<a x='" * 170_000, "<script>" * 100_000):
        assert len(main(hostile)) <= len(hostile)
    pages = spark.createDataFrame([], "page_id long, html string")
    assert html_text.extract(pages).count() == 0


def test_digest_is_of_the_kept_words():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
