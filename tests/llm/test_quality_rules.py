import random
import re
from collections import Counter

from casework.llm.quality_rules import COUNTS, apply_host_rules, host_rates, document_counts

SCHEMA = "doc_id long, text string, source string, n_words string, kept int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            inside |= {i, i + 1, i + 2}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside))


def fails(text):
    n, _, _, _, repeats = brute(text)
    return n < 50 or 100 * repeats > 50 * n


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def texts():
    rng = random.Random(8)
    out = [None, "", " \n\t", "a", "é é é é é", "a b c a b c", "x x x\nx x x\n x x x\n\n\n", "a\r\na\r\nb", "#*$%&|<> #"]
    for _ in range(150):
        words = [rng.choice("a b c dd é 日本 ** x|y".split()) for _ in range(rng.randrange(120))]
        out.append("".join(w + rng.choice([" ", " ", "\n", "\n\n", "\t"]) for w in words))
    out.append(" ".join(f"w{i}" for i in range(120000)))
    return out


def test_counts_against_brute_force(spark):
    rows = [(i, t, f"h{i % 3}") for i, t in enumerate(texts())]
    found = apply_host_rules(frame(spark, rows)).collect()
    assert {r.doc_id: tuple(r[c] for c in COUNTS) for r in found} == {i: brute(t) for i, t, _ in rows}
    assert {r.doc_id: r.base_failed for r in found} == {i: fails(t) for i, t, _ in rows}


def prose(i):
    return " ".join(f"word{i}x{j}" for j in range(60))


def test_host_verdict_needs_evidence(spark):
    rows = [(i, prose(i) + " ***" * 30, "bad") for i in range(200)]  # symbols: no base rule
    rows += [(1000 + i, prose(i), "good") for i in range(200)]
    rows += [(2000, prose(7) + " ***" * 30, "single")]
    rows += [(3000 + i, prose(i), f"h{i % 40}") for i in range(400)] + [(5000, prose(3), None), (None, prose(4), "good")]
    found = apply_host_rules(frame(spark, rows)).collect()
    kept = {r.doc_id: r.kept for r in found}
    assert len(found) == len(rows)
    assert not any(kept[i] for i in range(200))
    assert all(kept[i] for i in kept if i is None or i >= 1000)  # one bad page does not condemn its host
    assert not any(r.base_failed for r in found)


def test_rates_follow_the_prior(spark):
    rows = [(i, "short" if i % 4 == 0 else prose(i), f"h{i % 10}") for i in range(400)] + [(999, "short", "new")]
    rates = {r.source: r for r in host_rates(document_counts(frame(spark, rows))).collect()}
    raw = {}
    for i, t, h in rows:
        raw.setdefault(h, []).append(t == "short")
    shares = [sum(v) / len(v) for v in raw.values()]
    m = sum(shares) / len(shares)
    v = sum((s - m) ** 2 for s in shares) / len(shares)
    strength = min(max(m * (1 - m) / v - 1, 10), 1000)
    for h, flags in raw.items():
        assert abs(rates[h].short_rate - (sum(flags) + m * strength) / (len(flags) + strength)) < 1e-9


def test_empty_table_and_repeated_rows(spark):
    assert apply_host_rules(frame(spark, [])).count() == 0
    assert apply_host_rules(frame(spark, [(1, prose(1), "a")] * 3)).count() == 3
