"""The whole chain on odd cases against a plain version of its stages, one after the other."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tests.llm.conftest import CLASHING, DOCS, corpus, sentence
from tests.llm.test_links import WORD, grouped, lines_that_go, shingles_of

INSULTS = [f"vile{c}" for c in ("qq", "xx", "zz", "ww", "vv", "kk")]
LAST = 2**63 - 1


def table() -> list[tuple]:
    """The odd corpus with shorter long texts, repeated rows that are equal in every column, and toxic documents."""
    rng = random.Random(23)
    rows = [r for r in corpus() if r[0] not in (310, 311)]
    first = {}
    rows = [first.setdefault((r[0], r[1]), r) for r in rows]
    long = "\n".join(sentence(rng, 9) for _ in range(150))
    rows += [(i, long, "en", "src1", len(long), *CLASHING) for i in (310, 311)]
    for i in range(500, 530):
        words = sentence(rng, 30).split(" ")
        for _ in range(8):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        text = " ".join(words)
        rows.append((i, text, "en", "src0", len(text), *CLASHING))
    return rows


def without_toxic(rows):
    return [r for r in rows if not any(w in (r[1] or "") for w in INSULTS)]


def without_lines(rows):
    gone = defaultdict(set)
    for i, n, held in lines_that_go(rows):
        gone[i].add((n, held))
    out = []
    for i, text, *rest in rows:
        mine = gone[LAST if i is None else i]
        kept = [x for n, x in enumerate((text or "").split("\n")) if (n, words_set(x)) not in mine]
        out.append((i, text if len(kept) == len((text or "").split("\n")) else "\n".join(kept), *rest))
    return out


def words_set(line):
    return frozenset(w for (w,) in shingles_of(line, 1))


def without_near(rows):
    def name(row):
        return row[0], "" if row[1] is None else hashlib.sha256(row[1].encode()).hexdigest()

    own = {name(r): shingles_of(r[1], 5) for r in rows if r[0] is not None}
    names = sorted(own)
    sets = dict(enumerate(own[n] for n in names))
    linked = [(a, b) for a in sets for b in sets
              if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = grouped(list(sets), linked)
    stays = {names[i] for i, root in roots.items() if i == root}
    kept = [r for r in rows if r[0] is None or name(r) in stays]
    return list({(r[0], r[1]): r for r in kept}.values())


def mixed(rows):
    sizes = defaultdict(list)
    for r in rows:
        key = hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()
        sizes[r[3]].append((key, LAST if r[0] is None else r[0], len(WORD.findall(r[1] or "")), r))
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    total = {s: sum(x[2] for x in sizes[s]) for s in sources}
    target, rest, free = {}, Fraction(3, 2) * sum(total.values()), set(sources)
    while True:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * total[s]}
        if not full:
            break
        for s in full:
            target[s] = Fraction(2 * total[s])
            rest -= target[s]
        free -= full
    target |= {s: weight[s] * level for s in free}
    out = []
    for s in sources:
        epochs = target[s] // total[s]
        left = int(target[s] - epochs * total[s])
        for _, _, size, row in sorted(sizes[s], key=lambda x: x[:3]):
            out += [row] * int(epochs + (min(size, left) > 0))
            left = max(0, left - size)
    return out


def encoded(rows):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.TOKENIZER))
    found = Counter()
    for i, text, lang, source, *_ in rows:
        ids = model.encode(text or "")
        found[i, lang, source, tuple(ids), hashlib.sha256(model.decode(ids).encode()).hexdigest()] += 1
    return found


@pytest.mark.parametrize("partitions", [3, 11])
def test_chain_against_a_plain_version(spark, tmp_path, partitions):
    rows = table()
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).repartition(partitions).write.parquet(f"{folder}/documents.parquet")
    labels = sorted({(r[0], 1, int(r[0] >= 500)) for r in rows if r[0] is not None})
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    stages = [without_toxic, without_lines, without_near, mixed]
    counts, want = [], rows
    for stage in stages:
        want = stage(want)
        counts.append(len(want))
    assert counts[0] == len(rows) - 30 and counts[2] < counts[1] and counts[3] > counts[2]
    found = corpus_pipeline.run(spark, folder).collect()
    got = Counter((r["doc_id"], r["lang"], r["source"], tuple(r["ids"]), r["decoded_sha256"]) for r in found)
    assert got == encoded(want)
