import random

from casework.llm.linededup import dedupe_lines

SCHEMA = "doc_id long, text string, lang string, first int, row string"


def brute(rows, least):
    """Every run of lines with enough words, looked up among all earlier places."""
    rows = [(d, t) for d, t in rows]
    distinct = sorted({(d is None, d or 0, t) for d, t in rows if t is not None})
    lines = {}
    for key in distinct:
        lines[key] = [(i, tuple(x.split(" "))) for i, x in
                      ((i, " ".join(x.split())) for i, x in enumerate(key[2].split("\n"))) if x]
    first = {}
    for key in distinct:
        used = lines[key]
        for a in range(len(used)):
            for b in range(a, len(used)):
                run = tuple(x for _, x in used[a : b + 1])
                if sum(map(len, run)) >= least:
                    first.setdefault(run, (key, a))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0))
            continue
        key, gone = (d is None, d or 0, t), set()
        used = lines[key]
        for a in range(len(used)):
            for b in range(a, len(used)):
                run = tuple(x for _, x in used[a : b + 1])
                if sum(map(len, run)) >= least and first[run] != (key, a):
                    gone |= set(range(used[a][0], used[b + 1][0] if b + 1 < len(used) else t.count("\n") + 1))
        out.append((d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone), len(gone)))
    return sorted(out, key=repr)


def found(spark, rows, least):
    docs = spark.createDataFrame([(d, t, "en", 1, "r") for d, t in rows], SCHEMA)
    out = dedupe_lines(docs, least)
    assert out.columns == [*docs.columns, "n_deleted"]
    return sorted(((r.doc_id, r.text, r.n_deleted) for r in out.collect()), key=repr)


def test_shared_runs_against_brute_force(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 4, 9, 14]))) for _ in range(30)]
    rows = []
    for d in range(60):
        body = [rng.choice(pool + [""]) for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(3)):
            low = rng.randrange(25)
            body += pool[low : low + rng.randrange(1, 6)]
        rows.append((d, rng.choice(["\n", "\n \n"]).join(body)))
    assert found(spark, rows, 12) == brute(rows, 12)
    assert found(spark, rows, 5) == brute(rows, 5)


def test_passage_of_one_line_and_a_shorter_one(spark):
    long, short = " ".join(f"w{i}" for i in range(55)), " ".join(f"v{i}" for i in range(20))
    rows = [(i, f"own {i}\n{long}\n{short}\nend {i}") for i in range(5)]
    out = found(spark, rows, 50)
    assert out[0] == (0, rows[0][1], 0)
    assert out[3] == (3, "own 3\nend 3", 2)  # the run goes on over the short line


def test_edge_cases(spark):
    line = " ".join("x" * 60)
    rows = [(1, None), (2, ""), (None, line), (3, line), (3, line), (4, f"{line}\n{line}"), (5, "\n\n"), (None, line + " y"),
            (6, "word\n" * 20000 + line)]
    out = found(spark, rows[:-1], 50)
    assert out == brute(rows[:-1], 50)
    assert dict((d, n) for d, _, n in found(spark, rows[-1:] + [(0, line)], 50))[6] > 19000
    assert found(spark, [], 50) == []
