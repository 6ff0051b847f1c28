"""The native operators against brute force over the test tables and small fixtures."""

import collections
import hashlib
import math
import pathlib
import re

import pytest
import regex
from pyspark.sql import functions as F

from gridloom.llm import chat_format, exact_dedup, mixing, pii, queries, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, digest string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], DOCS)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# --- 1 -------------------------------------------------------------------


def chat_brute(turns):
    chats = collections.defaultdict(list)
    for c, n, r, t in turns:
        chats[c].append((n is not None, n or 0, r or "", t or ""))
    out = {}
    for c, ts in chats.items():
        ts.sort()
        loss = "".join(t[3] for t in ts if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3]}\n" for t in ts)
        out[c] = (len(ts), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_table(spark, sf):
    got = rows(queries.op1_chat_format(spark, sf))
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    want = chat_brute([*turns, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert {g["conv_id"]: (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) for g in got} == want


HARD = ["<s>", "</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>x", "[INST", "[/INST]</s><s>assistant[INST]", "é🎉\n", "", None, "[[INST]]", "<<s>>", "\\", "$1\\2"]


def test_chat_round_trip(spark):
    data = [(k // 2, k % 2, ("user", "assistant", "<s>", None)[(k // 3) % 4], t, "extra") for k, t in enumerate(HARD * 3)]
    data += [(None, None, "user", "no id", "extra"), (50, 1, "assistant", "tie", "e"), (50, 1, "assistant", "tie", "e")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    chats = chat_format.format_chats(df)
    got = rows(chats)
    assert all(g["round_trip"] for g in got)
    want = chat_brute([d[:4] for d in data])
    assert {g["conv_id"]: (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) for g in rows(chat_format.digests(chats))} == want
    for g in got:
        texts = [re.sub(r"([<\[]\\*)\\(?=/?(?:s>|INST\]))", r"\1", g["formatted"][s["start"] : s["end"]]) for s in g["loss_spans"]]
        assert texts == [t["text"] for t in g["turns"] if t["role"] == "assistant"]
        assert len(re.findall(r"</?s>|\[/?INST\]", g["formatted"])) == 4 * len(g["turns"])


def test_a_wrong_mask_shows_in_the_digest(spark):
    data = [(1, 0, "user", "a b"), (1, 1, "assistant", "x" * 100000 + "</s>é"), (1, 2, "assistant", "z")]
    chats = chat_format.format_chats(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    good, bad = rows(chat_format.digests(chats)), rows(chat_format.digests(chats.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct(s["start"].alias("start"), (s["end"] - 1).alias("end"))))))
    assert good[0]["loss_chars"] == 100006 and bad[0]["loss_chars"] == 100004 and good[0]["loss_sha256"] != bad[0]["loss_sha256"]


def test_chat_empty(spark):
    assert rows(chat_format.digests(chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))) == []


# --- 3 -------------------------------------------------------------------


def dedup_brute(items):
    groups = collections.defaultdict(list)
    for i, t in items:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for n, g in groups.items():
        best = min(g, key=lambda x: (x[0], x[1], x[2] or 0))
        sha = hashlib.sha256(n.encode()).hexdigest()
        stays = 1
        for x in g:
            kept = x == best and stays == 1
            stays -= kept
            out.append((x[2], best[2], len(g), kept, sha))
    return sorted(out, key=str)


def as_dedup(df):
    return sorted([(g["doc_id"], g["keep_id"], g["group_size"], g["kept"], g["text_sha256"]) for g in rows(df)], key=str)


def test_dedup_table(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert as_dedup(queries.op3_exact_dedup(spark, sf)) == dedup_brute(items)


CASES = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n"), (7, "ab"), (7, "ab"), (None, "zz"), (8, "zz"), (None, "q"), (None, "q"), (9, "é é"), (10, "éé"), (11, "a\u00a0b"), (12, "x" * 50000)]


def test_dedup_cases(spark):
    df = docs(spark, [(i, t, "s") for i, t in CASES])
    assert as_dedup(exact_dedup.exact_dedup(df)) == dedup_brute(CASES)
    kept = rows(exact_dedup.drop_copies(df))
    assert len(kept) == len({re.sub(r"\s", "", t or "") if t != "a\u00a0b" else t for _, t in CASES})
    same_id = rows(exact_dedup.drop_copies(docs(spark, [(7, "a b", "s"), (7, "a  b", "s"), (7, "ab", "s"), (8, "ab", "s"), (9, "c", "s")])))
    assert sorted((r["doc_id"], r["text"]) for r in same_id) == [(7, "a  b"), (9, "c")]
    assert set(kept[0]) == {"doc_id", "text", "lang", "source", "n_chars", "kept", "digest"}


def test_dedup_bytes_decide_when_digests_collide(spark):
    df = docs(spark, [(i, t, "s") for i, t in CASES])
    weak = exact_dedup.exact_dedup(df, digest=lambda t: F.unhex(F.hex(F.substring(t, 1, 1))))
    got = sorted([(g["doc_id"], g["keep_id"], g["group_size"], g["kept"]) for g in rows(weak)], key=str)
    assert got == sorted([x[:4] for x in dedup_brute(CASES)], key=str)


def test_dedup_empty(spark):
    assert rows(exact_dedup.exact_dedup(docs(spark, []))) == []


# --- 5 -------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def ok(kind, m):
    d = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        twice = [d[-1 - i] if i % 2 == 0 else 2 * d[-1 - i] - 9 * (d[-1 - i] > 4) for i in range(len(d))]
        return 13 <= len(d) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def pii_brute(text):
    spans = [(k, m.start(), m.end()) for k in BASE for m in re.finditer(BASE[k], text or "") if ok(k, m[0])]
    return [sum(s[0] == k for s in spans) for k in BASE], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def check_pii(got, texts):
    want = sorted(([i, *pii_brute(t)] for i, t in texts), key=str)
    assert sorted(([g["doc_id"], [g["n_email"], g["n_ip"], g["n_card"], g["n_phone"]], g["base_sha256"]] for g in got), key=str) == want


def test_pii_table(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_pii(rows(queries.op5_pii(spark, sf)), texts)


PII = [
    "a@b.com.d@e.fr a@b.c_d@e.fr x@@y.z a@b a@b. a@b.-c%d@e.f", "1.2.3.4.5.6.7.8 1.2.3 4.5.6.7 256.1.1.1 0255.0.0.1 00000.1.2.3 9999999999.1.1.1",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 4111  1111", "+1 (743) 555-3824 +49.30.1234567- ++12345678901 +1-", "é🎉 foo@bar.com 🎉1.2.3.4", "9" * 20000, "a" * 20000 + " a@" * 3000, "1 2 " * 5000,
    None, "", "1-2-3.4.5.6@7.8", "+1 2.3.4.5 6 7 8 9",
]


def test_pii_cases(spark):
    texts = list(enumerate(PII)) + [(0, PII[0]), (None, PII[1])]
    check_pii(rows(pii.digests(pii.pii(docs(spark, [(i, t, "s") for i, t in texts])))), texts)
    assert rows(pii.digests(pii.pii(docs(spark, [])))) == []


def term_brute(texts, alpha=pii.ALPHA, sure=pii.SURE):
    """The disclosing terms and each text's term spans, with dictionaries over all texts."""
    once, mark = {t or "" for t in texts}, "\ue000"
    held, n_t, levels, n_te = {}, collections.Counter(), collections.defaultdict(set), collections.Counter()
    values, seen = collections.defaultdict(set), collections.defaultdict(set)
    for t in once:
        bare = t
        for k in ("email", "phone", "ip", "card"):
            bare = re.sub(BASE[k], lambda m: mark if ok(k, m[0]) else m[0], bare)
        terms = {x for x in regex.findall(rf"[{mark}\p{{L}}\p{{N}}]+", bare.lower()) if mark not in x}
        n_t.update(terms)
        own = collections.defaultdict(set)
        for k in BASE:
            for m in re.finditer(BASE[k], t):
                if ok(k, m[0]):
                    d = re.sub("[^0-9]", "", m[0])
                    of = {"email": m[0].rsplit("@", 1)[-1].lower(), "ip": ".".join(m[0].split(".")[:2]), "card": d[:6], "phone": d[:4]}[k]
                    for level in ("any", k, f"{k}:{of}"):
                        own[level].add((k, m[0]))
        for level, vs in own.items():
            levels[level].add(t)
            values[level] |= vs
            for x in terms:
                n_te[x, level] += 1
                seen[x, level] |= vs
    n, known = len(once), set()
    for (x, level), k in n_te.items():
        p, q = len(levels[level]) / n, k / n_t[x]
        if k > 1 and p < 1 and len(values[level]) > 1 and math.log2(q / p) >= -alpha * math.log2(p):
            kl = q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0)
            if min(k, len(seen[x, level])) * kl / q >= math.log(sure * len(n_t)):
                known.add(x)
    for t in once:
        base = [m.span() for k in BASE for m in re.finditer(BASE[k], t) if ok(k, m[0])]
        held[t] = [m.span() for m in regex.finditer(r"[\p{L}\p{N}]+", t) if m[0].lower() in known and not any(a < m.end() and m.start() < b for a, b in base)]
    return known, held


def term_spans(found):
    return [(s["start"], s["end"]) for s in found["spans"] if s["kind"] == "term"]


def test_pii_terms_table(spark, sf):
    """The term spans of whole tables, against counting by hand; there are some, and they are real disclosures."""
    found = rows(pii.pii(spark.read.parquet(f"{sf}/documents.parquet"), keep_text=True))
    known, held = term_brute([g["text"] for g in found])
    assert all(term_spans(g) == held[g["text"]] for g in found)


def test_pii_terms_larger_table(spark, sf):
    found = rows(pii.pii(spark.read.parquet(f"{pathlib.Path(sf).parent}/sf0.1/documents.parquet"), keep_text=True))
    known, held = term_brute([g["text"] for g in found])
    assert all(term_spans(g) == held[g["text"]] for g in found)
    spans = [g["text"][a:b].lower() for g in found for a, b in term_spans(g)]
    # planted secrets are announced by the word "token"; they stand in texts with personal data
    assert len(spans) > 100 and sum(s == "token" for s in spans) >= 0.9 * len(spans)


FILLER = "some plain words of no use at all here the end " * 5


def disclosures():
    data = [(i, f"{FILLER} {'uvwxyz'[i]}word zorblax chairman {'uvwxyz'[i]}@corp.com now {FILLER} the Zorblax, far away", "s") for i in range(6)]
    return data + [(100 + i, f"{FILLER} mail and now {i} once more far away", "s") for i in range(30)]


def test_pii_terms(spark):
    data = disclosures() + [(200, f"{FILLER} zorblax, and no address", "s")]
    df = docs(spark, data).withColumn("row", F.lit(1)).withColumn("piece", F.lit("x")).withColumn("term", F.lit(1)).withColumn("spans", F.lit(1))
    found = {g["doc_id"]: g for g in rows(pii.pii(df, keep_text=True))}
    terms = {i: [g["text"][a:b] for a, b in term_spans(g)] for i, g in found.items()}
    assert terms[0] == ["zorblax", "chairman", "Zorblax"] and terms[200] == ["zorblax"] and not found[100]["spans"]
    known, held = term_brute([t for _, t, _ in data])
    assert known == {"zorblax", "chairman"} and all(term_spans(g) == held[g["text"]] for g in found.values())
    clean = {g["doc_id"]: g["text"] for g in rows(pii.sanitised(docs(spark, data)))}
    assert "@" not in clean[0] and "[EMAIL]" in clean[0] and "chairman" not in clean[0] and "orblax" not in clean[0] + clean[200] and clean[100] == data[6][1]


def test_pii_terms_with_digits(spark):
    """Account names, postal codes and numbers are terms; what a valid card, number or address covers is none, what an invalid one covers is."""
    data = [(i, f"{FILLER} contact handle42 at 90210 on 2024-07-{10 + i} via person{i}@mail.com, card 4111 1111 1111 1112 or +4930901820{i}5", "s") for i in range(20)]
    data += [(100 + i, f"{FILLER} contact me at {i} on monday via or mail 2024-07-01, card {i}", "s") for i in range(300)]
    found = {g["doc_id"]: g for g in rows(pii.pii(docs(spark, data), keep_text=True))}
    known, held = term_brute([t for _, t, _ in data])
    assert {"handle42", "90210", "1112", "4111"} <= known and not known & {"contact", "via", "card", "4930901820", "mail"}
    assert all(term_spans(g) == held[g["text"]] for g in found.values())
    clean = {g["doc_id"]: g["text"] for g in rows(pii.sanitised(docs(spark, data)))}
    assert "handle42" not in clean[3] and "90210" not in clean[3] and clean[107] == data[27][1]


def test_pii_masks(spark):
    """Marks by kind in texts with matches that are valid, invalid, beside each other and at the ends."""
    texts = ["1.2.3.4 300.1.2.3 4111111111111111", "a@b.c,d@e.f g", "x +49 30 901820 5 y +1 2", "4111 1111 1111 1111 12 4111 1111 1111 1112", "", "12 34", "9" * 25, "+4111111111111111", "1.2.3.4.5.6.7.8 end"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(pii.masked(F.col("t"))).collect()]
    for t, g in zip(texts, got):
        for k in ("email", "phone", "ip", "card"):
            t = re.sub(BASE[k], lambda m: pii.MARK if ok(k, m[0]) else m[0], t)
        assert g == t


def test_pii_terms_inside_a_copy_group(spark):
    """Thousands of copies of one of a term's texts neither hide the term nor make another one disclosing; nor do near copies with one value."""
    data = disclosures()
    data += [(1000 + i, data[0][1], "s") for i in range(3000)] + [(5000 + i, f"{FILLER} quux lone@corp.com {FILLER} {i % 4}", "s") for i in range(500)]
    found = {g["doc_id"]: g for g in rows(pii.pii(docs(spark, data), keep_text=True))}
    terms = lambda g: {g["text"][a:b].lower() for a, b in term_spans(g)}
    assert terms(found[0]) == terms(found[3]) == terms(found[2000]) == {"zorblax", "chairman"}
    assert not terms(found[5000]) and not found[100]["spans"]


# --- 8 -------------------------------------------------------------------


def targets_brute(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        t = {s: left * w[s] / sum(w[r] for r in rest) for s in rest} | {s: 3 * sizes[s] for s in full}
        over = [s for s in rest if t[s] > 3 * sizes[s]]
        if not over:
            return t
        full |= set(over)


def check_mix(got, items, close):
    sizes = collections.Counter()
    for _, t, s in items:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source, want, taken = {i: s for i, _, s in items}, targets_brute(sizes), collections.Counter()
    for g in got:
        s = source[g["doc_id"]]
        assert g["source_size"] == sizes[s] and g["target"] == pytest.approx(want[s])
        assert g["taken"] <= 3 * g["size"] and (g["size"] == 0 or g["taken"] % g["size"] == 0)
        taken[s] += g["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= close[s]
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_mix_table(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    most = collections.defaultdict(int)
    for _, t, s in items:
        most[s] = max(most[s], len(t.split()) / 2 + 1)
    first = rows(queries.op8_mixing(spark, sf))
    check_mix(first, items, most)
    assert sorted(map(str, first)) == sorted(map(str, rows(queries.op8_mixing(spark, sf))))


def test_mix_cases(spark):
    items = [(i, "w " * (i % 7), ("a", "b", None, "é", "hot")[i % 5]) for i in range(400)] + [(1000, "one", "tiny"), (1001, None, "none"), (1002, "", "none")]
    df = docs(spark, items)
    check_mix(rows(mixing.mix(df)), items, collections.defaultdict(lambda: 4))
    out = rows(mixing.mixed(df))
    assert sum(len((r["text"] or "").split()) for r in out) == sum(g["taken"] for g in rows(mixing.mix(df)))
    shards = collections.Counter(r["__shard"] for r in out)
    assert set(shards) <= set(range(mixing.LEAST_SHARDS))
    assert rows(mixing.mix(docs(spark, []))) == []
    assert all(g["taken"] == 0 for g in rows(mixing.mix(docs(spark, [(1, "", "a"), (2, None, None)]))))


def test_mix_repeated_and_null_ids(spark):
    """Rows that share an id, or id and text, are drawn each for itself: within a document of the target."""
    same = [(1, f"{k} " + "w " * 19, "a") for k in range(100)] + [(None, f"{k} " + "w " * 19, "b") for k in range(100)] + [(2, "v " * 20, "c")] * 100
    got = rows(mixing.mix(docs(spark, same)))
    sources = collections.Counter()
    for g in got:
        sources[g["doc_id"]] += g["taken"]
    want = targets_brute({"a": 2000, "b": 2000, "c": 2000})
    assert [abs(sources[i] - want[s]) <= 10 for i, s in ((1, "a"), (None, "b"), (2, "c"))] == [True] * 3
    df = docs(spark, same[:100] + same[200:250]).withColumn("__size", F.lit("clash")).withColumn("copies", F.lit(0)).withColumn("block", F.lit(0))
    out = rows(mixing.mixed(df))
    assert {r["__size"] for r in out} == {"clash"} and sum(r["doc_id"] == 1 for r in out) > 30


def test_mix_many_sources_and_long_texts(spark):
    items = [(i, "w " * (1 + i % 9), f"host{i % 700}") for i in range(2100)] + [(5000, "long " * 50000, "host1"), (5001, "long " * 30000, "big")]
    got = rows(mixing.mix(docs(spark, items)))
    most = collections.defaultdict(int)
    for _, t, s in items:
        most[s] = max(most[s], len(t.split()) / 2 + 1)
    check_mix(got, items, most)


def slots_frame(spark, quotas):
    return spark.createDataFrame([(s, False, b, 0) for s, n in quotas.items() for b in range(n)], "__src string, __none boolean, block long, pass int")


def test_splitting_tree_halves_every_node_exactly(spark):
    slots = slots_frame(spark, {"a": 40, "b": 56, "c": 32})
    placed = [r["shard"] for r in mixing.splitting_tree(slots, 8).collect()]
    for depth in range(4):
        assert set(collections.Counter(p >> (3 - depth) for p in placed).values()) == {128 >> depth}


def test_splitting_tree_is_multivariate_hypergeometric(spark):
    """Left halves over many seeds: mean and variance of each source's count, and their covariance, as drawing by hand without replacement."""
    quotas, counts = {"a": 12, "b": 20, "c": 8}, []
    slots = slots_frame(spark, quotas)
    drawn = [r for seed in range(60) for r in mixing.splitting_tree(slots, 2, seed).select("__src", "shard", F.lit(seed).alias("seed")).collect()]
    for seed in range(60):
        left = collections.Counter(r["__src"] for r in drawn if r["seed"] == seed and r["shard"] == 0)
        assert sum(left.values()) == 20
        counts.append([left[s] for s in quotas])
    means = [sum(c[k] for c in counts) / 60 for k in range(3)]
    for k, n in enumerate(quotas.values()):
        variance = n / 40 * (1 - n / 40) * 20 * 20 / 39
        assert abs(means[k] - n / 2) < 4 * math.sqrt(variance / 60)
        assert 0.5 * variance < sum((c[k] - n / 2) ** 2 for c in counts) / 60 < 1.7 * variance


def test_mix_shards_hold_every_source_by_words(spark):
    """Quotas follow words: a source's words a shard stay close to its share, and blocks grow in number with the source."""
    items = [(i, "w " * (20 + i % 30), "hot" if i % 3 else f"s{i % 4}") for i in range(12000)]
    out = mixing.mixed(docs(spark, items), words=256).groupBy("source", "__shard").agg(F.sum(F.size(F.split("text", " ")) - 1).alias("n"))
    by = collections.defaultdict(dict)
    for r in rows(out):
        by[r["source"]][r["__shard"]] = r["n"]
    assert all(len(x) == mixing.LEAST_SHARDS and max(x.values()) < 4 * min(x.values()) for x in by.values())


# --- 9 -------------------------------------------------------------------


def url_brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for v, h, p in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    if best:
        return host, path, *best
    spam = any(re.search(r.pattern, host + path) for r in url_filter.PATTERNS)
    return host, path, None, "block" if spam else "allow"


def test_urls_table(spark, sf):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = rows(queries.op9_url_filter(spark, sf))
    assert {g["page_id"]: (g["host"], g["path"], g["rule"], g["verdict"]) for g in got} == {i: url_brute(u) for i, u in urls.items()}


def test_url_cases(spark):
    urls = [
        None, "", "no scheme", "http://", "http://COM/", "http://com", "https://WWW.Example.COM/en/x?y#z", "https://a.www.example.com/en/", "https://example.com/EN/", "https://notexample.com/en/",
        "https://example.com?x=/en/", "http://x.net/es/1", "http://x.net/es", "http://net/fr/", "http://x.org/casino/", "http://x.org/casinos", "http://cheap-pills.org/", "http://é.org/spam#x", "a://b://c/d", "http://u@h:80/p", "http://examplexcom/en/",
    ]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(3, urls[3], "x", "y")], "page_id long, url string, host string, hits string")
    got = rows(url_filter.url_filter(df))
    assert len(got) == len(urls) + 1
    for g in got:
        assert (g["host"], g["path"], g["rule"], g["verdict"]) == url_brute(urls[g["page_id"]]), urls[g["page_id"]]
    assert rows(url_filter.url_filter(df.limit(0))) == []


@pytest.mark.parametrize("broadcast", [100_000, 10])
def test_ten_thousand_rules(spark, monkeypatch, tmp_path, broadcast):
    """Rules from a file, indexed by their rarest token; only fetched ones run, and the results are those of running all."""
    monkeypatch.setattr(url_filter, "BROADCAST", broadcast)
    rules = [url_filter.word_rule(f"w{k}", f"v{k % 97}") for k in range(9000)] + [url_filter.listed_rule("block" if k % 3 else "allow", f"h{k}.com", f"/p{k % 7}/") for k in range(1000)]
    rules += [*url_filter.LISTED, url_filter.Rule("odd", "block", "~{3}", ())]
    urls = [f"http://x{k}.org/w{k}-v{(k + k % 2) % 97}/" for k in range(300)] + [f"https://a.h{k}.com/p{k % 5}/x" for k in range(200)] + ["http://q.org/~~~", None, "http://q.org/" + "w7/v7/" * 5000]
    path = str(tmp_path / "rules")
    url_filter.rule_table(spark, tuple(rules)).write.json(path)
    df = spark.createDataFrame([(k, u, "x", 1) for k, u in enumerate(urls)], "page_id long, url string, rule string, row int")
    got = {g["page_id"]: g for g in rows(url_filter.url_filter(df, url_filter.read_rules(spark, path)))}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, where = url_brute(u)[:2]
        spot = host + where
        own = set(re.split("[^a-z0-9]+", spot.lower()))
        hits = [r for r in rules if own >= set(r.tokens) and re.search(r.pattern, spot)]
        best = min((r for r in hits if r.listed), key=lambda r: (-len(r.name), r.name), default=None)
        want = (best.name, best.verdict) if best else (None, "block" if any(not r.listed for r in hits) else "allow")
        assert (got[k]["rule"], got[k]["verdict"]) == want, u
    assert sum(g["n_candidates"] for g in got.values()) < 20 * len(urls)
