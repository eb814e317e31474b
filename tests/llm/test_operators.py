from __future__ import annotations

import hashlib
import math
import re
import weakref
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorum.llm import ann, chat_format, common, components, decontaminate, langid, mixing, near_dedup, secret_scan, token_counts, toxicity, url_filter, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators might use themselves.
CLASHING = ["key", "score", "hits", "size", "band", "cluster", "found", "language", "a", "b", "rank", "block", "copies"]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows], DOCS)


def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns with clashing names."""
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, " \t\n ", "en", "s"), (4, "word", "en", None), (4, "word", "en", None), (None, "null id text of six words", "de", "t"), (5, "x " * 30_000, "en", "s"), (6, "é" * 5_000, None, "t"), (7, "\ud7ff \U0001f600 漢字 ﬁ İ", "fr", "")]
    out = documents(spark, rows)
    return out.withColumns({c: F.lit("clash") for c in CLASHING})


def empty(spark):
    return documents(spark, [(1, "x", "en", "s")]).where("false")


def lowered(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


# --- chat formatting


TALKS = "conv_id long, turn long, role string, text string"


def test_prefixes_and_their_targets(spark):
    talks = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "b"), (2, 0, "user", "alone")], TALKS)
    found = {(r["conv_id"], r["target"]): r for r in chat_format.format_examples(talks).collect()}
    assert set(found) == {(1, 2), (1, 4), (2, None)}
    text = found[1, 4]["formatted"]
    assert text == "### user: hi</turn>\n### assistant: a</turn>\n### user: more</turn>\n### assistant: b</turn>\n"
    assert text[found[1, 4]["loss_start"] :][: found[1, 4]["loss_length"]] == "b"


def test_round_trip_of_hostile_texts(spark):
    texts = ["\\### Assistant: </turn> ok", "\\h\\\\b", "</turn>\n### user: x</turn>\n", "", "a:b # < \\", "\U0001f600\n\n"]
    rows = [(1, k, role, t) for k, t in enumerate(texts) for role in ["assistant" if k % 2 else "us:er</turn>\n#"]]
    found = chat_format.digests(chat_format.format_examples(spark.createDataFrame(rows, TALKS))).first()
    said = "".join(f"{r[2]}\n{r[3]}\n" for r in rows)
    trained = "".join(r[3] for r in rows if r[2] == "assistant")
    assert found["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert found["loss_sha256"] == hashlib.sha256(trained.encode()).hexdigest()
    assert (found["n_turns"], found["loss_chars"]) == (len(rows), len(trained))


def test_odd_conversations(spark):
    rows = [(None, 0, "assistant", "x"), (None, 1, "user", "yy"), (3, None, None, None), (3, 0, "assistant", None), (3, 0, "assistant", None), (4, 0, "user", "y" * 50_000)]
    talks = spark.createDataFrame(rows, TALKS).withColumns({"turns": F.lit(1), "target": F.lit(2), "place": F.lit(3), "loss": F.lit(4)})
    found = chat_format.digests(chat_format.format_examples(talks)).collect()
    assert sorted((r["n_turns"], r["loss_chars"], r["n_examples"]) for r in found if r["conv_id"] is None) == [(1, 0, 1), (1, 1, 1)]
    found = {r["conv_id"]: r for r in found}
    assert (found[3]["n_turns"], found[3]["loss_chars"], found[4]["n_turns"]) == (3, 0, 1)
    assert chat_format.format_examples(talks.where("false")).count() == 0


# --- URL filter


def test_urls_against_rules(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("a.com", "", "block"), ("b.com", "/x", "allow"), ("b.com", "/x", "block")]
    urls = ["http://EXAMPLE.com/en/1", "http://x.example.com/en/79?q", "ftp://a.com", "a.com/en/", None, "http://", "http://b.com/xy#z", "http://notexample.org/en/7", "http://com/en/", "http://ba.com/en/", "http://b.com/xy#z", "x://" + "l." * 3_000 + "com/en/" + "p" * 5_000]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, rule string").withColumns({"short": F.lit(1), "digest": F.lit(2), "copies": F.lit(3)})
    pages = pages.union(pages.where("page_id = 0"))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")

    def judge(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[2:] if fit else (None, "allow")))

    found = sorted((tuple(r) for r in url_filter.judge_urls(pages, table).collect()), key=repr)
    want = sorted([(k, *judge(u)) for k, u in [*enumerate(urls), (0, urls[0])]], key=repr)
    assert found == want
    assert url_filter.judge_urls(pages.where("false"), table).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, table.where("false")).collect()} == {"allow"}


def test_many_rules_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    test_urls_against_rules(spark)


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_sixty_thousand_rules_under_one_suffix(spark, monkeypatch, hot_rows):
    """Every page has the expressions of ``com``, one of them a rule: hot expressions are broadcast, and results are the same."""
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    rules = spark.range(60_000).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("host"), F.lit("/a/").alias("path"), F.lit("block").alias("verdict"))
    rules = rules.union(spark.createDataFrame([("com", "/", "block"), ("h7.com", "/a/b", "allow")], rules.schema))
    pages = spark.range(4_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), F.col("id") % 200, F.lit(".com/"), F.when(F.col("id") % 2 == 0, "a/").otherwise("c/"), F.col("id")).alias("url"))
    pages = pages.union(spark.createDataFrame([(4_000, "http://h7.com/a/b?"), (4_001, "http://h7.org/a/b"), (4_002, None)], pages.schema))
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    want = {k: (f"h{k % 200}.com/a/", "block") if k % 2 == 0 else ("com/", "block") for k in range(4_000)}
    assert found == want | {4_000: ("h7.com/a/b", "allow"), 4_001: (None, "allow"), 4_002: (None, "allow")}


# --- mixing


def targets(sizes, share=1.5, repeats=2, weights=(5, 2, 1)):
    """By brute force: give out by weight, cap, and share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if repeats * sizes[s] <= level * weight[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = repeats * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def mixed(spark, docs):
    rows = mixing.mix(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(spark, seed):
    rng = np.random.default_rng(seed)
    sources = ["a", "b", "c", "é", None, "d"]
    rows = [(k, "w " * int(rng.integers(0, 60)), "en", sources[min(int(rng.exponential(1.2)), 5)]) for k in range(1500)]
    docs = documents(spark, rows)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    size = {k: len(WORD.findall(t)) for k, t, *_ in rows}
    source = {k: s for k, _, _, s in rows}
    total = Counter()
    for k in size:
        total[source[k]] += size[k]
    want, taken = targets(total), Counter()
    for r in found:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in total)
    assert sum(taken.values()) <= 1.5 * sum(size.values())
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_mix_of_many_ranges_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 100)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    test_mix_meets_its_targets(spark, 3)


@pytest.mark.parametrize("run", [3, 10_000])
def test_mix_of_alike_documents(spark, monkeypatch, run):
    """A third of the rows without an id, another third one row: places are those of a plain running total."""
    monkeypatch.setattr(mixing, "ALIKE_ROWS", run)
    rows = [(None, "w " * (k % 4), "en", "s") for k in range(60)] + [(7, "w w", "en", "s")] * 60 + [(100 + k, "w " * (k % 9), "en", "t") for k in range(60)]
    found = mixing.mix(documents(spark, rows)).collect()
    sizes = Counter((i, len(t.split())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"]) for r in found) == sizes
    done, total = 0, sorted(r["finish"] * 5 for r in found if r["doc_id"] is None or r["doc_id"] == 7)
    digest = lambda i, n: int(hashlib.md5("|".join(["17", *([] if i is None else [str(i)]), str(n)]).encode()).hexdigest()[:15], 16)
    want = []
    for (i, n), c in sorted(((k, c) for k, c in sizes.items() if k[0] in (None, 7)), key=lambda x: digest(*x[0])):
        for _ in range(c):
            done += n
            want.append(done)
    assert total == pytest.approx(want)


def test_mix_of_odd_documents(spark):
    assert mixing.mix(odd(spark)).count() == 9
    assert mixing.mix(empty(spark)).count() == 0
    only = mixing.mix(documents(spark, [(1, None, None, None)])).first()
    assert (only["size"], only["taken"]) == (0, 0)


# --- secrets


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.train_forest(secret_scan.labelled_findings(spark, 2_000))


HEX = hashlib.sha1(b"secret").hexdigest()


def test_secrets_are_told_from_lookalikes(spark, forest):
    texts = [f'the token = "{HEX}" of', f'TOKEN = "{HEX.upper()}"!!', "call 4929963689861572 now", "see blog.example.com/path/to/the/page1", "mail ath.58@mail5.example.com", f"sha1 {HEX}", 'api_key: "your_example_placeholder_key_here1"', "uuid: 123e4567-e89b-12d3-a456-426614174000", None, ""]
    found = secret_scan.scan(documents(spark, [(k, t, "en", "src1") for k, t in enumerate(texts)]), forest)
    assert {(r["doc_id"], r["secret"]) for r in found.collect()} == {(0, HEX), (1, HEX.upper())}


def test_forest_expression_is_spark_s_forest(spark):
    """Row by row, on findings that the forest has not seen."""
    model = secret_scan.fit_forest(secret_scan.labelled_findings(spark, 1_000), trees=5)
    written = secret_scan.read_forest(model, spark)
    unseen = secret_scan.labelled_findings(spark, 1_600).withColumn("at", F.monotonically_increasing_id()).orderBy(F.desc("at")).limit(600).drop("at")
    named = secret_scan.features(F.col("candidate"), F.col("before"), F.col("path"))
    own = unseen.select("candidate", "before", "path", F.struct(*[c.alias(k) for k, c in named.items()]).alias("f")).select(secret_scan.forest_score(written, F.col("f")).alias("score"))
    spark_s = model.transform(secret_scan.vectors(unseen))
    assert [r["score"] for r in own.collect()] == pytest.approx([r["probability"][1] for r in spark_s.collect()])


def test_forest_generalises(spark, forest):
    held_out = secret_scan.labelled_findings(spark, 3_000).where("label >= 0").orderBy(F.xxhash64("candidate")).limit(800)
    named = secret_scan.features(F.col("candidate"), F.col("before"), F.col("path"))
    rows = held_out.select("label", F.struct(*[c.alias(k) for k, c in named.items()]).alias("f"))
    right = rows.select(((secret_scan.forest_score(forest, F.col("f")) >= 0.5).cast("double") == F.col("label")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.97


def test_redaction(spark, forest):
    docs = documents(spark, [(1, f'a token = "{HEX}" and again {HEX}, {HEX}x', "en", "s"), (2, "nothing", "en", None), (3, None, None, None)])
    found = {r["doc_id"]: r for r in secret_scan.redact(docs, forest).collect()}
    assert HEX not in found[1]["text"] and found[1]["text"].startswith('a token = "[SECRET]" and again [SECRET]')
    assert found[1]["n_chars"] == len(found[1]["text"]) and found[2]["text"] == "nothing" and found[3]["text"] is None
    assert secret_scan.redact(docs, forest).columns == docs.columns
    clashing = docs.withColumns({"findings": F.lit("mine"), "_findings": F.lit("own"), "found_tokens": F.lit(1)})
    assert [tuple(r) for r in secret_scan.redact(clashing, forest).select("findings", "_findings", "found_tokens").distinct().collect()] == [("mine", "own", 1)]
    assert secret_scan.redact(odd(spark), forest).count() == 9 and secret_scan.scan(empty(spark), forest).count() == 0


def test_candidates_are_assigned_values_and_long_tokens(spark):
    texts = {
        f"TOKEN={HEX}": [("TOKEN=", HEX)],
        'aws_secret_access_key = "wJalrXUtnFEMI/K7MDENG"': [('aws_secret_access_key = "', "wJalrXUtnFEMI/K7MDENG")],
        'password = "Tr0ub4dor&3"': [('password = "', "Tr0ub4dor&3")],
        "a\npasswd: hunter, x": [("passwd: ", "hunter")],
        f"url=https://x.com/?token={HEX}&u=b": [("url=", "https://x.com/"), (f"url=https://x.com/?token=", HEX), (f"oken={HEX}&u=", "b")],
        f"env:MY_TOKEN={HEX}": [("env:MY_TOKEN=", HEX)],
        f'{{"api_key":"{HEX}", "n": ["{HEX}"]}}': [('{"api_key":"', HEX), (f'{{"api_key":"{HEX}", "n": ["'[-48:], HEX)],
        "std::string a == b at 12:30, https://x.com/a != c": [],
        f"somewhatlongerwordsstand before {HEX}": [("somewhatlongerwordsstand before ", HEX)],
        "a=dGVzdA==": [("a=", "dGVzdA==")],
    }
    rows = documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    found = {r["doc_id"]: [(h["before"], h["candidate"]) for h in r["f"] or []] for r in secret_scan.with_findings(rows, [0.0], "f").collect()}
    assert found == dict(enumerate(texts.values()))


def test_assigned_secrets_are_found(spark, forest):
    secrets = [(f"TOKEN={HEX}", HEX), (f'aws_secret_access_key = "{HEX}"', HEX), ("api_key=sk_live_" + HEX[:24], "sk_live_" + HEX[:24]), ('password = "Tr0ub4dor&3"', "Tr0ub4dor&3"), ("DB_PASSWORD=kGwXvTbqRzMn", "kGwXvTbqRzMn"), (f"token={HEX}", HEX), (f"export API_KEY={HEX}", HEX), (f"https://x.com/?token={HEX}", HEX), ("use ghp_" + "a8Kd02LmQx7Zt4Vb9Ns1Pw3Rf6Yh5Jc0Ge" + " here", "ghp_a8Kd02LmQx7Zt4Vb9Ns1Pw3Rf6Yh5Jc0Ge")]
    harmless = ["title: Tr0ub4dor&3", "password: required", "max_tokens = 100", "the token expires at: 12", "color = blue", "n: 5", "https://x.com/a", f"commit {HEX}", "see the_long_name_of_a_file_2.txt"]
    rows = documents(spark, [(k, t, "en", "src1") for k, t in enumerate([t for t, _ in secrets] + harmless)])
    assert {(r["doc_id"], r["secret"]) for r in secret_scan.scan(rows, forest).collect()} == {(k, s) for k, (_, s) in enumerate(secrets)}
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redact(rows, forest).collect()}
    assert all(masked[k] == t.replace(s, "[SECRET]") for k, (t, s) in enumerate(secrets))
    assert [masked[len(secrets) + k] for k in range(len(harmless))] == harmless


def test_long_runs_do_not_overflow(spark, forest):
    texts = ["a=" + "x,." * 50_000, "a=b" * 50_000, "a=" + "." * 50_000, "k=\"" + "?&" * 50_000, "y" * 100_000, "1" * 100_000]
    assert secret_scan.redact(documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)]), forest).count() == len(texts)
    assert secret_scan.scan(documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)]), forest).count() >= 0


# --- near duplicates


def brute_classes(docs):
    sets = {}
    for i, t in docs:
        w = lowered(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and label[x] != label[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                low, high = sorted((label[x], label[y]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in ids}


def near_copies(seed=3, families=12, members=9):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for _ in range(families):
        base = [vocabulary[j] for j in rng.integers(0, 400, int(rng.integers(4, 90)))]
        for _ in range(members):
            copy = list(base)
            for _ in range(int(rng.integers(0, 5))):
                copy[int(rng.integers(0, len(copy)))] = vocabulary[int(rng.integers(0, 400))]
            rows.append((k, " ".join(copy) if rng.random() < 0.8 else "\n ".join(copy).upper()))
            k += 1
    return [*rows, (k, None), (k + 1, ""), (k + 2, " "), (k + 3, "one"), (k + 4, "ONE"), (k + 5, "one two three four"), (k + 6, "x " * 3_000)]


@pytest.mark.parametrize("blocks", [(1_024, 512), (3, 2)])
def test_near_duplicates_are_those_of_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", blocks[1])
    rows = near_copies()
    found = near_dedup.near_duplicates(documents(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_classes(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows = near_copies(5, 4, 6)
    found = near_dedup.near_duplicates(documents(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_classes(rows)


def test_hot_families_are_settled_in_two_passes(spark, monkeypatch):
    """A family that is most of the rows, with members that resemble only each other, in many small blocks."""
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):
        drift = [f"v{j}" for j in range(k % 20)]  # members 15 steps apart share less than three quarters
        copy = base[: 60 - len(drift)] + drift
        copy[int(rng.integers(0, 60))] = f"x{k % 7}"
        rows.append((k, " ".join(copy)))
    rows += [(100 + k, " ".join(base)) for k in range(20)]
    found = near_dedup.near_duplicates(documents(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_classes(rows)


def test_near_duplicates_of_odd_documents(spark):
    rows = near_dedup.near_duplicates(odd(spark)).collect()
    assert len(rows) == 9 and [r["component_id"] for r in rows if r["doc_id"] == 4] == [4, 4]
    assert all(r["kept"] for r in rows)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("limit", [10, 10_000])
def test_components_of_chains_and_random_links(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "TASK_LINKS", limit)
    rng = np.random.default_rng(1)
    monkeypatch.setattr(common, "HOT_ROWS", 8)
    links = [(k, k + 1) for k in range(40)] + [(int(a) + 100, int(b) + 100) for a, b in rng.integers(0, 60, (40, 2))] + [(300, 301 + k) for k in range(40)] + [(400 + k, 500) for k in range(40)]
    label = {k: k for link in links for k in link}
    for a, b in links:
        low, high = sorted((label[a], label[b]))
        label = {k: low if v == high else v for k, v in label.items()}
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["root"] for r in found.collect()} == {k: v for k, v in label.items() if k != v}


def clique(n):
    return [(a, b) for b in range(n) for a in range(b)]


def test_redundant_links_take_no_rounds(spark, monkeypatch):
    def rounds(links):
        raise AssertionError("a round began")

    monkeypatch.setattr(components, "TASK_LINKS", 100)
    monkeypatch.setattr(components, "_with_least", rounds)
    found = components.components(spark.createDataFrame(clique(60), "a long, b long"))
    assert {r["node"]: r["root"] for r in found.collect()} == dict.fromkeys(range(1, 60), 0)


def test_components_of_links_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_LINKS", 10)
    links = clique(20) + [(k, k + 1) for k in range(100, 140)] + [(300, 301 + k) for k in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {**dict.fromkeys(range(1, 20), 0), **dict.fromkeys(range(101, 141), 100), **dict.fromkeys(range(301, 341), 300)}


def test_hot_and_cold_keys_are_looked_up(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 8)
    for sizes in ({1: 3, 2: 8}, {1: 3, 2: 9}, {}):
        rows = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)], "k long, i long")
        known = spark.createDataFrame([(k, -k, n) for k, n in sizes.items()], "k long, x long, n long")
        got = common.lookup(rows, known, "k")
        assert got.columns == ["k", "i", "x"] and sorted(map(tuple, got.collect())) == sorted((k, i, -k) for k, n in sizes.items() for i in range(n))


def queries_of(spark, of):
    """The number of queries that ``of`` runs."""

    def last():
        spark.range(1).count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        return spark._jsparkSession.sharedState().statusStore().executionsList().last().executionId()

    before = last()
    of()
    return last() - before - 1


def test_counts_take_no_queries_of_their_own(spark, monkeypatch):
    """Each query holds memory of the driver: a lookup runs one, and components of few links two."""
    rows = spark.createDataFrame([(k % 3, k) for k in range(40)], "k long, v long")
    known = rows.groupBy("k").agg(F.count("*").alias("n"))
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    for hot in (rows, rows.where("false")):
        assert queries_of(spark, lambda: common.lookup(rows, known.join(hot.select("k").distinct(), "k", "left_semi"), "k")) == 1
    chain = spark.createDataFrame([(k, k + 1) for k in range(8)], "a long, b long")
    assert queries_of(spark, lambda: components.components(chain)) == 2
    texts = documents(spark, [(k, f"a b c d e f g h i j k l m n o p q r s t {k % 40}", "en", "s") for k in range(80)])
    assert queries_of(spark, lambda: near_dedup.near_duplicates(texts)) == 13
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 8)
    assert queries_of(spark, lambda: near_dedup.near_duplicates(texts)) == 18


# --- toxicity


def test_scores_are_those_of_brute_force():
    rng = np.random.default_rng(6)
    model = toxicity.Model(rng.normal(0, 0.1, toxicity.BUCKETS).astype(np.float32), -0.5)

    def score(text):
        words = []
        for word in WORD.findall((text or "").lower()):
            marked = [32, *map(ord, word), 32]
            parts = [marked[k : k + n] for n in toxicity.NGRAMS for k in range(len(marked) - n + 1)]
            values = []
            for part in parts:
                total = np.uint64(0)
                for c, place in zip(part, toxicity._PLACES):
                    total = total + np.uint64(c) * place
                values.append(model.buckets[int(toxicity.mix64(np.array([total]), len(part))[0] % np.uint64(toxicity.BUCKETS))])
            words.append(np.mean(values, dtype=np.float64) if values else 0.0)
        return 1 / (1 + np.exp(-(toxicity.SCALE * (np.mean(words) if words else 0.0) + model.bias)))

    texts = ["You are a fool", "a", "", None, "é ü\tx", "😀 long " * 40, "İstanbul ﬁne"]
    with np.errstate(over="ignore"):
        assert list(model.scores(texts)) == pytest.approx([score(t) for t in texts], abs=1e-6)


def test_training_texts_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2_000)
    docs = documents(spark, [(k, f"{k} " + "x" * 15, "en", "s") for k in range(200)] + [(500, "y" * 21, "en", "s")])
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(200)] + [(500, 0, 1)], "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample(docs, labels, F.lit(True))
    assert 1_500 < sum(len(t) for t, _ in sample) <= 2_000 and not any("y" in t for t, _ in sample)
    assert sample == toxicity.labelled_sample(docs.repartition(5), labels, F.lit(True))


def test_training_is_a_task_and_not_the_driver_s(spark, monkeypatch):
    docs = documents(spark, [(k, f"{'bad' if k % 3 else 'good'} word{k} ß", "en", "s") for k in range(60)])
    labels = spark.createDataFrame([(k, 0, int(k % 3 > 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample(docs, labels, F.lit(True))
    expected = toxicity.train([text for text, _ in sample], [label for _, label in sample])

    def refused(*_):
        raise AssertionError("the driver trains")

    monkeypatch.setattr(toxicity, "train", refused)
    model = toxicity.train_on(docs, labels, F.lit(True))
    assert np.allclose(model.buckets, expected.buckets, atol=1e-5) and model.bias == pytest.approx(expected.bias, abs=1e-5)


def test_toxicity_generalises_to_misspellings(spark):
    rng = np.random.default_rng(0)
    clean = [f"{a}{b}" for a in ("ter", "lan", "mio", "pes", "dor") for b in ("a", "en", "ik", "os", "um", "ly")]
    bad = ["stupid", "idiot", "moron", "trash"]
    texts = [[clean[j] for j in rng.integers(0, 30, 25)] for _ in range(300)]
    labels = [int(k % 3 == 0) for k in range(300)]
    for t, y in zip(texts, labels):
        if y:
            t[3] = t[11] = bad[int(rng.integers(0, 4))]
    model = toxicity.train([" ".join(t) for t in texts], labels)
    cases = ["lana you stupidd moronn idiott", "teren lanik mioos pesum dorly", None, "", "x"]
    scores = model.scores(cases)
    assert scores[0] > 0.5 and scores[1] < 0.3 and all(0 <= s <= 1 for s in scores)
    assert list(model.scores(cases[::-1]))[::-1] == pytest.approx(list(scores))


def test_toxicity_of_odd_documents(spark):
    labels = spark.createDataFrame([(2, 1, None), (4, 1, 1), (5, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train_on(odd(spark), labels, F.lit(True))
    rows = toxicity.with_scores(odd(spark), model, "s").collect()
    assert len(rows) == 9 and all(0 <= r["s"] <= 1 for r in rows)
    nothing = toxicity.train_on(odd(spark), labels.where("false"), F.lit(True))
    assert all(r["s"] < 1e-9 for r in toxicity.with_scores(odd(spark), nothing, "s").collect())
    assert toxicity.with_scores(empty(spark), nothing).count() == 0


# --- decontamination


def brute_hits(text, items):
    w, out, grams = lowered(text), {}, {}
    shingles = lambda x: Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4)) if len(x) >= 5 else Counter([tuple(x)])
    for i, item in items:
        own = lowered(item)
        if not own or not w or (len(own) < 5 and len(w) < len(own)):
            continue
        n = min(5, len(own))
        if n not in grams:
            grams[n] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        if not any(tuple(own[k : k + n]) in grams[n] for k in range(len(own) - n + 1)):
            continue  # nothing in common
        best = 0
        for start in range(max(1, len(w) - len(own) + 1)):
            window, want = shingles(w[start : start + len(own)]), shingles(own)
            same, union = sum((window & want).values()), sum((window | want).values())
            if len(w) >= 5 or len(own) < 5:
                best = max(best, same / union if 4 * same >= 3 * union else 0)
        if best:
            out[i] = best
    return out


def test_decontamination_is_that_of_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(300)]
    draw = lambda n: [words[j] for j in rng.integers(0, 300, n)]
    items = [(k, " ".join(draw(int(rng.integers(8, 40))))) for k in range(20)] + [(50, "short one"), (51, "repeat " * 12), (52, None), (53, " ")]
    texts = []
    for k in range(60):
        passage = items[k % 20][1].split()
        for _ in range(int(rng.integers(0, 3))):
            passage[int(rng.integers(0, len(passage)))] = "changed"
        texts.append(" ".join(draw(int(rng.integers(0, 50))) + passage + draw(int(rng.integers(0, 50)))))
    texts += [items[0][1], " ".join(items[1][1].split()[:-2]), "a SHORT\tone b", "repeat " * 40, None, "", "w1"]
    docs = documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: {h["item_id"]: h["similarity"] for h in r["hits"]} for r in decontaminate.with_hits(docs, benchmark).collect()}
    assert found == {k: brute_hits(t, items) for k, t in enumerate(texts)}


def test_decontamination_of_a_phrase_in_thousands_of_items(spark):
    """Items and texts that share one phrase cost their sizes, not their number, and only whole items are found."""
    phrase = "all items hold these very words at once"
    items = [(k, f"{phrase} " + " ".join(f"w{k}x{j}" for j in range(20))) for k in range(5_000)]
    index = decontaminate.Index(items)
    assert len(index.of) == len(index.keys)  # one size for each shingle
    texts = [f"{phrase} and nothing more of them", items[77][1], f"before {items[4_999][1]} after", "", None]
    assert [[h[0] for h in hits] for hits in index.hits(texts)] == [[], [77], [4_999], [], []]


def test_decontamination_in_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "INDEX_WORDS", 40)
    test_decontamination_is_that_of_brute_force(spark)


def test_odd_documents_hold_no_item(spark):
    benchmark = spark.createDataFrame([(1, "some words that no document has here"), (None, "x"), (2, None)], "item_id long, text string")
    assert all(r["h"] == [] for r in decontaminate.with_hits(odd(spark), benchmark, "h").collect())
    assert all(r["h"] == [] for r in decontaminate.with_hits(odd(spark), benchmark.where("false"), "h").collect())
    assert decontaminate.with_hits(empty(spark), benchmark).count() == 0


@pytest.mark.parametrize("words", [5, 200_000])
def test_items_with_null_ids_are_matched_by_text(spark, monkeypatch, words):
    monkeypatch.setattr(decontaminate, "INDEX_WORDS", words)
    alive, most = weakref.WeakSet(), []

    def counted(self, items, make=decontaminate.Index.__init__):
        make(self, items)
        alive.add(self)
        most.append(len(alive))

    monkeypatch.setattr(decontaminate.Index, "__init__", counted)
    items = [(None, "one two three four five six"), (None, "seven eight nine ten eleven twelve"), (None, None), (7, "one two three four five six"), (7, "a b c d e f g")]
    rows = documents(spark, [(1, "x one two three four five six y", "en", "s"), (None, f"{items[1][1]} and {items[0][1]}", "en", "s"), (2, "clean", "en", "s"), (3, None, "en", "s"), (2, "clean", "en", "s")])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((str(r["doc_id"]), sorted(str(h["item_id"]) for h in r["h"])) for r in decontaminate.with_hits(rows, benchmark, "h", null_ids=True).collect())
    assert found == [("1", ["7", "None"]), ("2", []), ("2", []), ("3", []), ("None", ["7", "None", "None"])]
    assert max(most) == 1 and (len(most) > 1) == (words == 5)
    assert decontaminate.with_hits(rows.withColumn("hits", F.lit("clash")), benchmark).columns[-2:] == ["hits", "_hits"]


# --- languages


def test_languages(spark):
    rng = np.random.default_rng(1)
    parts = {"en": ["the", "ing", "tion", "and"], "fr": ["eau", "oux", "ère", "que"], "de": ["sch", "ung", "heit", "über"]}
    rows = [(k, " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(20)), lang, "s") for k in range(240) for lang in [list(parts)[k % 3]]]
    docs = documents(spark, rows)
    held_out = F.col("doc_id") % 4 == 1
    found = langid.with_languages(docs.drop("lang"), langid.learn(docs, ~held_out)).collect()
    right = {i: lang for i, _, lang, _ in rows}
    assert np.mean([r["language"]["lang_pred"] == right[r["doc_id"]] for r in found if r["doc_id"] % 4 == 1]) > 0.98


def test_text_vectors_are_sums_of_bound_letters():
    text = "Ab-c d"
    letters = lambda s: langid.letter_vectors(np.array([ord(c) for c in s]))
    want = np.zeros(langid.DIMS)
    for gram in (" ab", "ab ", "b c", " c ", "c d", " d "):
        x = letters(gram)
        want += np.roll(x[0], 2) * np.roll(x[1], 1) * x[2]
    assert np.array_equal(next(langid.text_vectors([text]))[0], want)


def test_empty_partitions(spark):
    docs = documents(spark, [(1, "some words of a text here", "en", "s"), (2, "noch ein Text mit Worten", "de", "t")]).repartition(16)
    assert langid.with_languages(docs, langid.learn(docs, F.lit(True))).count() == 2
    assert near_dedup.near_duplicates(docs).count() == 2
    assert mixing.mix(docs).count() == 2


def test_odd_languages(spark):
    rows = langid.with_languages(odd(spark), langid.learn(odd(spark), F.lit(True))).collect()
    assert {r["language"] for r in rows} == {"clash"}
    assert {r["doc_id"]: r["_language"]["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert all(0 <= r["_language"]["score"] <= 1 for r in rows)
    nothing = langid.learn(empty(spark), F.lit(True))
    assert {r["_language"]["lang_pred"] for r in langid.with_languages(odd(spark), nothing).collect()} == {"und"}


def brute_languages(rows):
    """(lang, cosine) of each text against the bundles of all texts of a language, straight from the definition."""
    bundles = {}
    for text, lang in rows:
        v = next(langid.text_vectors([text]))[0].astype(np.float64)
        bundles[lang] = bundles.get(lang, 0) + np.rint(v / max(np.linalg.norm(v), 1) * langid.UNIT)
    out = []
    for text, _ in rows:
        v = next(langid.text_vectors([text]))[0].astype(np.float64)
        out.append(max(((v @ b / np.linalg.norm(v) / np.linalg.norm(b), lang) for lang, b in sorted(bundles.items())), key=lambda x: x[0]))
    return out


@pytest.mark.parametrize(("n", "held", "sent"), [(40, 1_000, 50_000), (40, 7, 0)])
def test_languages_in_slices_are_those_of_brute_force(spark, monkeypatch, n, held, sent):
    monkeypatch.setattr(langid, "SLICE_LANGS", held)
    monkeypatch.setattr(langid, "BROADCAST_LANGS", sent)
    rng = np.random.default_rng(4)
    rows = [("".join(chr(97 + int(c)) for c in rng.integers(0, 26, 60)) + " word", f"l{k % n:03d}") for k in range(3 * n)]
    docs = documents(spark, [(k, t, lang, "s") for k, (t, lang) in enumerate(rows)])
    found = {r["doc_id"]: r["language"] for r in langid.with_languages(docs, langid.learn(docs, F.lit(True))).collect()}
    for k, (cosine, lang) in enumerate(brute_languages(rows)):
        assert (found[k]["lang_pred"], found[k]["score"]) == (lang, pytest.approx(cosine))


# --- token counts


def test_token_counts_keep_a_column_of_their_name(spark):
    row = token_counts.with_token_counts(documents(spark, [(1, "x", "en", "s")]).withColumn("n_tokens", F.lit("clash")), [("▁", 0.0), ("▁x", -1.0)]).first()
    assert (row["n_tokens"], row["_n_tokens"]) == ("clash", 1)


def test_token_counts_are_those_of_the_tokenizers_library(spark, sf):
    import random

    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    whole = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    oracle = Tokenizer(models.Unigram(whole, unk_id=0, byte_fallback=True))
    oracle.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    draw = random.Random(5)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["".join(draw.choice("abthe \n\té▁ ÿ漢😀x.  ") for _ in range(draw.randint(0, 40))) for _ in range(400)]
    docs = documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts.with_token_counts(docs, token_counts.read_vocabulary(path)).collect()}
    assert found == {k: len(oracle.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_ties_go_to_the_piece_that_begins_first():
    counter = token_counts.Counter([("▁", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aab", -3.0)])
    assert counter.word("▁aab") == 2  # ▁ aab, as good as ▁ a ab and ▁ a a b
    assert counter.count("zé") == 1 + 1 + 2  # mark, and the bytes of unknown characters


def test_odd_token_counts(spark):
    vocabulary = [("▁", 0.0), ("▁x", -1.0)]
    rows = {r["doc_id"]: r["n"] for r in token_counts.with_token_counts(odd(spark), vocabulary, "n").collect()}
    assert (rows[1], rows[2], rows[5]) == (0, 0, 30_001)
    assert token_counts.with_token_counts(empty(spark), vocabulary).count() == 0


# --- nearest neighbours


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 300)
    monkeypatch.setattr(vectors, "PART_ROWS", 3)
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 1, (8, 24))
    x = (centres[rng.integers(0, 8, 1500)] + rng.normal(0, 0.4, (1500, 24))).astype(np.float32)
    x[700:760] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 24), (2200, [float("nan")] * 24), (2300, [None] * 24), (None, [1.0] * 24), (5, x[5].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in CLASHING})
    found = ann.nearest_neighbours(table, F.col("vec_id") % 100 == 0).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert set(got) == {100 * k for k in range(15)} and all(len(v) == 10 for v in got.values())
    hits, y = 0, x.astype(np.float64)
    for q, near in got.items():
        exact = sorted((math.sqrt(((y[q] - y[k]) ** 2).sum()), k) for k in range(1500) if k != q)[:10]
        hits += len({k for _, k in near} & {k for _, k in exact})
        assert near == sorted(near) and all(d == pytest.approx(math.sqrt(((y[q] - y[k]) ** 2).sum())) for d, k in near)
    assert hits >= 0.95 * 150
    assert [k for _, k in got[0]] == list(range(700, 710))
    assert ann.nearest_neighbours(table.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    few = ann.nearest_neighbours(table.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 100 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]


def test_recall_over_many_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (20_000, 32))
    x[1:400] = x[0]  # one very common vector
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = {}
    for r in ann.nearest_neighbours(table, F.col("vec_id") % 400 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, near in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(near & set(np.lexsort((np.arange(len(x)), d))[:10].tolist()))
    assert len(got) == 50 and hits >= 0.95 * 500


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 6) == pytest.approx(12.591587243743977)


def test_very_long_texts(spark, forest):
    """Ten megabytes in one text, beside short ones: whole texts count, and pieces stay bounded."""
    words = " ".join(f"w{k % 1_000}" for k in range(2_100_000))
    item = " ".join(f"q{k}" for k in range(20))
    long = f"{words} {item} token = \"{HEX}\" end"
    docs = documents(spark, [(1, long, "en", "s"), (2, long + " x", "en", "s"), (3, "short text of a few words", "de", "t"), (4, None, None, None)])
    assert len(long) > 10_000_000
    n = len(long.split())
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {1: n, 2: n + 1, 3: 6, 4: 0}
    found = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert found[2]["component_id"] == 1 and found[1]["n_shingles"] > 1_000 and found[4]["n_shingles"] == 0
    hits = {r["doc_id"]: [h["start"] for h in r["hits"]] for r in decontaminate.with_hits(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert hits == {1: [2_100_000], 2: [2_100_000], 3: [], 4: []}
    assert {r["doc_id"]: r["language"]["lang_pred"] for r in langid.with_languages(docs, langid.learn(docs, F.lit(True))).collect()} == {1: "en", 2: "en", 3: "de", 4: "und"}
    assert toxicity.with_scores(docs, toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), -2.0)).where("score < 0.2").count() == 4
    assert token_counts.with_token_counts(docs, [("▁", 0.0), ("▁x", -1.0)]).where("n_tokens > 2100000").count() == 2
    assert [r["secret"] for r in secret_scan.scan(docs, forest).orderBy("doc_id").collect()] == [HEX, HEX]


def test_folds_are_by_crc32(spark):
    from quorum.llm.common import text_crc

    assert [r[0] for r in spark.range(5).select(text_crc(F.col("id"))).collect()] == [zlib.crc32(str(k).encode()) for k in range(5)]
    assert spark.range(1).select(text_crc(F.lit(None).cast("long"))).first()[0] == 0


def test_pieces_are_bounded_in_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(common, "PIECE_BYTES", 100)
    monkeypatch.setattr(common, "PIECE_ROWS", 4)
    sizes = np.array([10, 20, 300, 5, 5, 5, 5, 5, 90, 20])
    assert list(common._runs(sizes)) == [(0, 2), (2, 3), (3, 7), (7, 9), (9, 10)]


@pytest.mark.parametrize("hot", [1, 1_000])
def test_lookups_of_hot_and_other_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = spark.createDataFrame([(k % 3 if k % 2 else 0, k) for k in range(40)] + [(9, 99)], "key long, v long")
    known = rows.where("key <> 9").groupBy("key").agg(F.count("*").alias("n")).withColumn("w", F.col("key") * 10)
    found = sorted((r["key"], r["v"], r["w"]) for r in common.lookup(rows, known, "key").collect())
    assert found == sorted((r["key"], r["v"], r["key"] * 10) for r in rows.collect() if r["key"] != 9)
