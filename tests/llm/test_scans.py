import collections
import hashlib
import re

from capstan.llm import licenses, pii, token_counts

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def base_of(text):
    w = WORDS.findall(lower(text))
    at = [(i, lab) for p, lab in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})))


def test_licence_base_matches_brute_force(spark, odd, odd_rows):
    more = [(20, "Under the GNU General Public  License; Apache-License APACHE LICENSE, cc by cc BY by", "en", "s"),
            (21, "gnu general public", "en", "s"), (22, "MIT\nlicenseé mit license", "en", "s"), (22, "MIT license", "en", "s"),
            (None, "cc_by", "en", "s")]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in more], "doc_id long, text string"))
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(docs).collect())
    assert got == collections.Counter((r[0], *base_of(r[1])) for r in [*odd_rows, *more])


def test_licence_notices_are_found_by_position(spark):
    far = " ".join(f"filler{k}" for k in range(300))
    docs = spark.createDataFrame([
        (1, f"{far} Redistribution and use in source and binary forms, with or without modification, are permitted {far}"),
        (2, "Licensed under CC BY-NC 4.0."), (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, f"redistribution {far} binary {far} forms"), (5, "Released under the MIT License."),
        (6, "Mozilla Public License, v. 2.0")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert got[1]["labels"] == "bsd" and got[1]["base_labels"] == "" and 0 < got[1]["score"] <= 1
    assert got[2]["labels"] == "cc-by,cc-by-nc" and got[3]["labels"] == "gpl,gpl-3.0"
    assert got[4]["labels"] == "" and got[4]["score"] == 0 and got[5]["labels"] == "mit" and got[6]["labels"] == "mpl-2.0"


RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def ok(kind, s):
    d = re.sub(r"[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def spans_of(text):
    out = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(RULES) for m in re.finditer(p, text or "") if ok(kind, m.group())]
    return ",".join(f"{RULES[k][0]}:{s}:{e}" for s, k, e in sorted(out))


def test_base_spans_match_plain_regexes():
    import random

    r = random.Random(3)
    parts = ["a@b.c", "x..y@q-1.com.", "@", "@@z.de", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111-",
             "+1 (212) 555-0100", "+12", "+49 30 1234567 x", "007.08.9.1", " ", "-", ".", "12", "a", "%+", "\U0001F600"]
    for _ in range(4000):
        t = "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randrange(9)))
        assert ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in pii.base_spans(t)) == spans_of(t), t


def test_personal_data_of_odd_rows(odd, odd_rows):
    odd_rows = [r for r in odd_rows if not (r[1] or "").startswith("1111")] + [r for r in odd_rows if (r[1] or "").startswith("1111")]
    got = collections.Counter((r["doc_id"], r["base"], r["spans"]) for r in pii.find_personal_data(odd).collect())
    want = collections.Counter()
    for r in odd_rows:
        s = "" if (r[1] or "").startswith("1111") else spans_of(r[1])
        want[(r[0], s, s)] += 1
    assert got == want


def test_patterns_find_what_no_rule_catches(spark):
    rows = [(k, f"please call our desk phone number +1 212 555 {1000 + k} today") for k in range(12)]
    rows += [(50, "please call our desk phone number 1-212-555-9999x today"), (51, "serial phone +1 212 555 7777 part 77-1234-99 end")]
    rows += [(60 + k, f"reach staff mail address user{k}@corp.example now") for k in range(8)] + [(80, "reach staff mail address user99@corpexample now")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["spans"] == got[0]["base"] == "phone:34:49"
    assert got[51]["spans"] == got[51]["base"]
    cards = [f"{n}{d}" for n in range(401288888888000, 401288888888020) for d in range(10) if pii.luhn(f"{n}{d}")]
    twin = [(k, f"account card no {n} please") for k, n in enumerate(cards)] + [(30, "account card no 4012888888881882 please")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(twin, "doc_id long, text string")).collect()}
    assert got[30]["base"] == "" and got[30]["spans"] == "ctx-card:16:32"


def test_personal_data_of_empty_table(none):
    assert pii.find_personal_data(none).count() == 0 and licenses.scan(none).count() == 0 and token_counts.count_tokens(none).count() == 0


def test_token_counts_match_the_library(odd, odd_rows):
    encode = token_counts.load_encoder("piece_bpe_32k.model")
    for name in ("piece_bpe_32k.model", "byte_bpe_50k.json"):
        encode = token_counts.load_encoder(name)
        got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(odd, name).collect())
        assert got == collections.Counter((r[0], len((r[1] or "").encode()), encode([r[1] or ""])[0]) for r in odd_rows)


def test_cache_is_used_and_appended(spark, tmp_path):
    path = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "three")], "doc_id long, text string")
    first = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, cache_path=path).collect()}
    assert spark.read.parquet(path).count() == 2 and first[1] == first[2]
    mark = spark.createDataFrame([(token_counts.tokenizer_digest("piece_bpe_32k.model"), bytearray(hashlib.sha256(b"four").digest()), 99),
                                  ("other", bytearray(hashlib.sha256(b"five").digest()), 77)], token_counts.CACHE_SCHEMA)
    mark.write.mode("append").parquet(path)
    more = spark.createDataFrame([(3, "three"), (4, "four"), (5, "five")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(more, cache_path=path).collect()}
    assert got[3] == first[3] and got[4] == 99 and got[5] != 77
    assert spark.read.parquet(path).count() == 5
