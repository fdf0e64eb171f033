"""Sentences, lines and paragraphs side by side; scripts without spaces."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from tableflow.llm import lines
from tableflow.llm.queries import op5_substring_dedup
from tests.llm import brute, edge

MARK = re.compile("(?<=[。！？．｡।॥؟۔])(?=[^\\s])")


def _words(text):
    """(start, end, word) of a text, parted behind marks too."""
    out = []
    for m in brute.SPACE_WORD.finditer(text.encode()):
        at = m.start()
        for part in MARK.split(m.group().decode()):
            size = len(part.encode())
            out.append((at, at + size, part.encode().translate(brute.LOWER)))
            at += size
    return out


def _ranges(raw, found):
    """(first, last + 1) words of every sentence, line and paragraph."""
    out = set()
    for level in range(3):
        head = 0
        for k in range(1, len(found) + 1):
            gap = raw[found[k - 1][1] : found[k][0]].count(b"\n") if k < len(found) else 9
            closed = found[k - 1][2].decode()[-1] in ".!?。！？．｡।॥؟۔"
            if gap > (level == 2) or (level == 0 and closed):
                out.add((head, k))
                head = k
    return sorted(out)


def _brute(rows, words=5, size=lines.MIN_BYTES):
    every = []
    for order, (_, text) in enumerate(rows):
        raw, found = (text or "").encode(), _words(text or "")
        for a, z in _ranges(raw, found):
            w = tuple(x for *_, x in found[a:z])
            if len(w) >= words or sum(map(len, w)) >= size:
                every.append((w, (order, a), (found[a][0], found[z][0] if z < len(found) else len(raw))))
    firsts = {}
    for w, place, _ in every:
        firsts[w] = min(firsts.get(w, place), place)
    gone = [set() for _ in rows]
    for w, place, span in every:
        if firsts[w] != place:
            gone[place[0]].update(range(*span))
    return [None if t is None else bytes(b for k, b in enumerate(t.encode()) if k not in gone[i]).decode() for i, (_, t) in enumerate(rows)]


def _all(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return lines.line_dedup(df, "all", min_bytes=lines.MIN_BYTES).collect()


def test_all_levels_equal_brute_force(spark):
    r = random.Random(8)
    pieces = ["Go. Now. Or. Stay. Here.", "home\nabout\ncontact\nnews\nhelp", "今天天气很好我们去公园。好！明天再来这里看一看吧？", "สวัสดีชาวโลกทุกคน", "短句。", "Menu", edge.prose(4, 20), edge.prose(5, 12, end=3)]
    rows = [(i, "".join(r.choice(pieces) + r.choice([" ", "\n", "\n\n", ""]) for _ in range(r.randrange(1, 9)))) for i in range(60)]
    rows += [(1000 + i, t) for i, (_, t, *_) in enumerate(edge.rows())]
    got = {x.doc_id: x for x in _all(spark, rows)}
    assert [got[i].text for i, _ in rows] == _brute(rows)
    for x in got.values():
        ends = [s.end for s in x.spans]
        assert all(s.start >= e for s, e in zip(x.spans[1:], ends))


def _repeated(line, short):
    return [(1, line), (2, f"x\n{line}\ny"), (3, short), (4, f"a\n{short}\nb"), (5, f"{line}。新"), (6, f"前。{line}。后")]


def test_repeats_without_spaces_and_of_short_sentences_go(spark, tmp_path):
    line, short = "今天天气很好我们去公园散步", "Go. Now. Or. Stay. Here."
    got = {r.doc_id: r.n_removed for r in _all(spark, _repeated(line, short))}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 1}
    # The query and the stage: the same of longer ones, and short ones stay.
    rows = _repeated(line * 3, " ".join([short] * 3)) + [(i + 100, t) for i, t in _repeated(line, short)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_removed for r in op5_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: int(i in (2, 4, 6)) for i, _ in rows}
    kept = cp.drop_repeated_sentences(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "unused").collect()
    assert {r.doc_id: r.text for r in kept} == dict(rows) | {2: "x\ny", 4: "a\nb", 6: "前。后"}


def test_as_much_goes_as_by_sentences(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    fine = Counter({r.doc_id: r.removed_bytes for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()})
    got = {r.doc_id: r for r in _all(spark, rows)}
    assert all(got[i].removed_bytes >= n for i, n in fine.items())
    assert [got[i].text for i, _ in rows] == _brute(rows)


def test_passages_within_longer_sentences_go(spark):
    """No unit of these texts repeats, but a passage in the middle does."""
    r = random.Random(5)
    some = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    long, longer, short = some(51), some(400), some(25)
    rows = [(i, f"{some(20 + i)} {p} {some(30)}") for i, p in enumerate([long, long, longer, longer, short, short, "and " * 80, "and " * 90, long])]
    rows += [(20, None), (21, ""), (22, long)]
    for batch in (1, 3):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(batch)
        got = {x.doc_id: x for x in lines.line_dedup(df, "all", lines.LONG_WORDS, min_bytes=lines.LONG_BYTES, passage_words=lines.PASSAGE_WORDS).collect()}
        assert {i for i in got if got[i].n_removed} == {1, 3, 7, 8, 22}
        for i, text in rows:
            x = got[i]
            assert (x.text is None) == (text is None)
            raw = (text or "").encode()
            gone = [raw[s.start : s.end].decode() for s in x.spans]
            assert all(s.start >= p.end for p, s in zip(x.spans, x.spans[1:])) and sum(map(len, gone)) == x.removed_bytes
            # All that goes stands in an earlier document.
            assert all(any(j < i and t and g.strip() in t for j, t in rows) for g in gone)
        assert got[3].removed_bytes > 0.85 * len(longer)


@pytest.mark.parametrize("share", [lines.WINDOW_SHARE, 1.0])
def test_common_windows_are_ranges_at_once(spark, monkeypatch, share):
    """Of a passage that all documents share, each has one range, not one per
    window, and whether windows are broadcast changes no result."""
    monkeypatch.setattr(lines, "WINDOW_SHARE", share)
    shared = edge.prose(77, 300, end=10**9)
    rows = [(i, f"{edge.prose(300 + i, 60, end=10**9)} {shared} {edge.prose(600 + i, 60, end=10**9)}") for i in range(40)]
    docs = spark.createDataFrame(rows, f"{lines.ROW} bigint, text string")
    found = lines.passages(docs, lines.PASSAGE_WORDS).collect()
    assert (len(found) <= 2 * 39) == (share < 1)
    covered = {}
    for x in found:
        covered.setdefault(x[lines.ROW], set()).update(range(x.start, x.end))
    assert sorted(covered) == list(range(1, 40))
    for i, text in rows[1:]:
        begin = text.encode().index(shared.encode())
        inner = range(begin + len(" ".join(shared.split()[:26])) + 1, begin + len(" ".join(shared.split()[:-26])))
        assert covered[i].issuperset(inner)
        assert not covered[i] - set(range(begin, begin + len(shared) + 1))
