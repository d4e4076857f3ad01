"""Exact and line dedup against plain Python."""
import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scrollwork.llm.exact_dedup import exact_groups
from scrollwork.llm.line_dedup import drop_repeated_lines


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep))
    return Counter(out)


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, odd, odd_rows, weak):
    kw = {"digest": lambda c: F.lit(b"d")} if weak else {}
    got = exact_groups(odd, salts=3, **kw).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert Counter(map(tuple, got)) == exact_brute(odd_rows)


def test_exact_empty(none):
    assert exact_groups(none).count() == 0


def lines_brute(rows, min_chars=20, min_docs=3):
    blank = " \t\n\x0b\x0c\r"
    up = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    key = lambda x: x.strip(blank).translate(up)
    docs = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars and i is not None:
                docs[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(docs[key(x)]) < min_docs or i == max(docs[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_lines(odd, odd_rows):
    got = drop_repeated_lines(odd).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    want = lines_brute(odd_rows)
    assert Counter(map(tuple, got)) == want
    assert sum(k[2] for k in want) > 3


def test_lines_empty(none):
    assert drop_repeated_lines(none).count() == 0
