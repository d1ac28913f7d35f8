import random
import re
import unicodedata

from grammarlens.llm import copies


def form(line):
    def kept(s):
        return "".join(c for c in s if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd").lower()

    main, _, fragment = line.partition("#")
    head, _, query = main.partition("?")
    return kept(head), tuple(sorted(p for p in map(kept, re.split("[&;]", query)) if p)), kept(fragment)


def brute(rows):
    groups = {}
    for i, line in rows:
        if line is not None and line.strip() and not line.strip().startswith("#"):
            groups.setdefault(form(line), []).append(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def variants(rng, n):
    words = ["a", "B1", "ñandú", "c-d", "x", "10", "é", "%2F", "&", ";", "", "=", "ß", "日本"]
    lines = []
    for _ in range(n):
        head = "/".join(rng.choices(words, k=2))
        query = [f"{rng.choice(words)}={rng.choice(words)}" for _ in range(rng.randint(0, 3))]
        rng.shuffle(query)
        line = f"http://{head}" + ("?" + rng.choice("&;").join(query) if query or rng.random() < 0.2 else "") + rng.choice(["", "#", "#f", "#f?x&y"])
        lines.append(rng.choice([line, line.swapcase() if "ß" not in line else line, f" {line}\t", line.replace("/", " / ")]))
    return lines + [None, "", "  ", " # note", "#", "　", "?", "#?", "&", "x" * 200_000, "X" * 200_000]


def run(spark, rows, wide="uri_id long, uri string"):
    table = spark.createDataFrame(rows, wide)
    half = len(rows) // 2
    lines = copies.lines(table.where(f"uri_id < {half}").selectExpr("*", "1 as form", "2 as segment"), table.where(f"uri_id >= {half}"))
    repeats, alone = copies.split_repeats(lines, len(rows), both=len(rows) % 2 == 0)
    found = copies.groups(repeats)
    return {tuple(r) for r in copies.members(repeats, found, len(rows)).collect()}, lines, repeats, alone


def test_against_brute_force(spark):
    rows = list(enumerate(variants(random.Random(5), 1500)))
    got, lines, repeats, alone = run(spark, rows)
    assert got == brute(rows)
    assert repeats.count() + alone.count() == lines.count()


def test_a_full_filter_costs_only_false_repeats(spark, monkeypatch):
    monkeypatch.setattr(copies, "MOST_SEGMENTS", 1)
    monkeypatch.setattr(copies, "SEGMENT", 1 << 15)
    rows = [(i, f"http://h/{i // 2 if i % 3 else i}x{i % 3}") for i in range(4000)]
    assert run(spark, rows)[0] == brute(rows)


def test_fewer_bits_are_set_where_there_are_fewer_for_a_line():
    assert copies.sized(0) == (1, 3) and copies.sized(1_000_000) == (489, 3)
    assert copies.sized(10**8)[1] == 3 and copies.sized(3 * 10**8)[1] == 2 and copies.sized(10**9) == (1 << 16, 1)


def test_a_hot_form(spark):
    rows = [(i, "http://hot/" + "." * (i % 7)) for i in range(3000)] + [(i, f"http://h/{i % 4000}") for i in range(3000, 9000)]
    assert run(spark, rows)[0] == brute(rows)


def test_nothing(spark):
    assert run(spark, [(1, None), (2, "a")])[0] == set()
    assert copies.split_repeats(copies.lines(spark.createDataFrame([], "uri_id long, uri string")), 0)[0].count() == 0
