"""Plain Python versions of the operators' results, for small tables."""

import os
import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def link_classes(docs, num, den, k):
    """docs: [(id, text)]: position -> (size, class as a frozenset of positions)."""
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    seen = Counter()
    for at in where.values():
        for p in combinations(at, 2):
            seen[p] += 1
    for (i, j), both in seen.items():
        if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    members = defaultdict(list)
    for i in range(len(docs)):
        members[find(i)].append(i)
    return [(len(sets[i]), members[find(i)]) for i in range(len(docs))]


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dups = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dups += x in seen
            seen.add(x)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    n = len(w)
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dups, "n_repeat_words": len(covered), "base_failed": n < 20 or 100 * len(covered) > 30 * n}


def tables(sf_dir, *names):
    """A DuckDB connection with views of the tables (files or folders of files)."""
    import duckdb

    con = duckdb.connect()
    for t in names:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con
