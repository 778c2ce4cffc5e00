"""Values that no rule catches, found by the words around them."""

import random

from capstan.llm import pii


def test_one_unseen_value_of_each_kind_is_found_in_a_trusted_context(spark):
    cards = [f"{n}{d}" for n in range(401288888888000, 401288888888012) for d in range(10) if pii.luhn(f"{n}{d}")]
    say = {"phone": "please call our desk phone number {} today", "email": "reach staff mail address {} now",
           "ip": "server with host address {} went down", "card": "account card no {} please"}
    known = {"phone": [f"+1 212 555 {1000 + k}" for k in range(12)], "email": [f"user{k}@corp.example" for k in range(12)],
             "ip": [f"10.0.0.{k}" for k in range(12)], "card": cards}
    unseen = {"phone": ["(212) 555-0199", "212 555 9999", "1-212-555-9999x"], "email": ["jane@corpexample", "jane.doe [at] corp.example", "jane at corp dot example"],
              "ip": ["fe80::1ff:fe23:4567:890a", "10.0.0.300", "10.1.2"], "card": ["4012888888881882", "4012.8888.8888.1882", "401288888888"]}
    for pick in range(3):
        rows, want = [], {}
        for kind, text in say.items():
            for v in known[kind]:
                rows.append((len(rows), text.format(v)))
            value, at = unseen[kind][pick], text.index("{")
            want[len(rows)] = f"ctx-{kind}:{at}:{at + len(value)}"
            rows.append((len(rows), text.format(value)))
            rows.append((len(rows), text.format("nobody")))                 # a word of no kind in the same slot
            rows.append((len(rows), f"a number without such words {value} stands here"))
        got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for i, _ in rows:
            if i in want:
                assert got[i]["base"] == "" and got[i]["spans"] == want[i], rows[i]
        # the same value is left alone where its words are not trusted
        assert all(r["spans"] == r["base"] for i, r in got.items() if i not in want)


def test_candidates_take_time_in_proportion_to_the_text():
    for text in ("x" * 200_000 + " 1", "1" * 200_000 + "@", "a." * 100_000 + "(at)", "1 " * 100_000, "1.1." * 50_000 + " @ "):
        pii.mentions(text, pii.base_spans(text))


def test_the_graph_picks_one_reading_of_neighbouring_words_with_digits(spark):
    rows = [(100 + k, f"you can call me at +1 212 555 {1000 + k} or later") for k in range(100)]
    want = {20: ("you can call me at 0301234567 2 times", "0301234567"),
            21: ("you can call me at 212 555 9999 or later", "212 555 9999"),
            22: ("you can call me at 555 9999 or later 7", "555 9999"),
            # the words on both sides are surer than the number of digits
            23: ("you can call me at 0309876543 2 or later", "0309876543 2"),
            24: ("you can call me at 12 or later", None)}
    rows += [(i, t) for i, (t, _) in want.items()]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (t, value) in want.items():
        at = t.index(value) if value else 0
        assert got[i]["spans"] == (f"ctx-phone:{at}:{at + len(value)}" if value else ""), t


def test_words_of_any_length_are_a_context(spark):
    a, b = "x" * 300, "y" * 100_000
    rows = [(k, f"{a} {b} user{k}@corp.example {b}") for k in range(12)]
    value = "j" * 300 + " [at] corp.example"
    rows.append((12, f"{a} {b} {value} {b}"))
    rows.append((13, f"{a} {b[1:]} {value} {b[1:]}"))
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = len(a) + len(b) + 2
    assert got[12]["spans"] == f"ctx-email:{at}:{at + len(value)}" and got[13]["spans"] == ""


def test_context_words_are_those_of_the_whole_text():
    rnd = random.Random(5)
    for _ in range(3000):
        text = "".join(rnd.choice(["a", "Bc", "é", " ", " ", "1", "22", ".", "@", "_", "-" * 70, "w" * 70, "\n", "c@d.ef", "+1 23 456 7890", "="]) for _ in range(rnd.randrange(30)))
        for value, s, e, kind, _, share, patterns in pii.mentions(text, pii.base_spans(text)):
            left, right = pii.WORD.findall(text[:s].lower())[-2:], pii.WORD.findall(text[e:].lower())[:1]
            plain = ([f"{left[0]} {left[1]} _"] if len(left) == 2 else []) + ([f"{left[-1]} _ {right[0]}"] if left and right else [])
            assert patterns == [pii.key_of(p) for p in plain] and value == pii.key_of(text[s:e]), (text, s, e)
            assert 0 < share <= 1 and (kind < 0 or share == 1)
