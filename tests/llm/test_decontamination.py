from __future__ import annotations

import random

from orrery.llm import decontamination as D


def words(n, rng, vocabulary=20_000):
    return [f"v{int(vocabulary * rng.random() ** 2)}" for _ in range(n)]


def found(spark, docs, items):
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return [(r["doc_id"], r["item_id"]) for r in got.collect()]


def brute(docs, items):
    out, hashed = set(), [(j, D.word_hashes(t.encode())) for j, t in items]
    for i, text in docs:
        hashes = D.word_hashes(text.encode())
        near = set(hashes.tolist())
        for j, h in hashed:
            if sum(x in near for x in h.tolist()) >= D.PARAPHRASE * len(h) and any(D.check(h, h[-D.ANSWER_WORDS :], hashes, w) for w in range(max(1, -(-len(hashes) // D.BLOCK)))):
                out.add((i, j))
    return out


def test_recall_with_thousands_of_items(spark):
    rng = random.Random(6)
    items = [(j, " ".join(words(rng.randrange(16, 60), rng))) for j in range(3000)]
    docs = []
    for i in range(160):
        text = words(rng.randrange(100, 400), rng)
        if i % 4:
            at = rng.randrange(len(text))
            text[at:at] = rng.choice(items)[1].split()
        docs.append((i, " ".join(text)))
    got, want = found(spark, docs, items), brute(docs, items)
    assert len(want) >= 120 and len(got) == len(set(got)) and set(got) <= want
    assert len(want & set(got)) >= 0.9 * len(want)


def test_whole_copies_of_long_items(spark):
    rng = random.Random(7)
    items = [(j, " ".join(words(n, rng))) for j, n in enumerate((60, 64, 65, 97, 200, 400, 500, 700, 1000, 3000))]
    docs = []
    for j, t in items:
        text = words(150, rng)
        text[70:70] = t.split()
        docs += [(j, " ".join(text)), (100 + j, " ".join(words(300, rng)))]
    assert sorted(found(spark, docs, items)) == [(j, j) for j, _ in items]


def test_passages_cover_the_item():
    for n in (1, 48, D.ONE_PASSAGE, D.ONE_PASSAGE + 1, 96, 97, 1000):
        item = D.np.arange(n)
        parts = D.passages(item)
        assert sorted(set(D.np.concatenate(parts).tolist())) == list(range(n)) and (len(parts) == 1) == (n <= D.ONE_PASSAGE)


def test_spaces_are_fitted_on_all_passages(spark):
    """12,000 passages: a basis of the 10,000 or so that a sample takes is another one."""
    rng = random.Random(8)
    docs = [(i, " ".join(words(960, rng, 6000))) for i in range(600)]
    items = [(j, D.word_hashes(" ".join(words(40, rng, 6000)).encode())) for j in range(20)]
    kept = D.cut(D.passage_words(spark.createDataFrame(docs, "doc_id long, text string")))
    (index,) = D.fit_indexes(kept, [(j, h, h[-8:]) for j, h in items])

    size, omega = D.RANK + D.OVERSAMPLE, D._random_matrix().astype(float)
    gram, back = D.np.zeros((size, size)), D.np.zeros((D.FEATURES, size))
    hashed = [D.word_hashes(t.encode()) for _, t in docs]
    corpus = [h[i : i + D.WINDOW] for h in hashed for i in range(0, len(h), D.WINDOW)]
    for weight, rows in (((10_000 / len(corpus)) ** 0.5, corpus), (D.ITEM_WEIGHT, [h for _, h in items])):
        for h in rows:
            terms, w = D._weights(h, index.idf)
            y = weight * w @ omega[terms]
            gram += D.np.outer(y, y)
            back[terms] += weight * D.np.outer(w, y)
    basis = D._basis(gram, back)
    latent = D.np.array([w @ basis[terms] for terms, w in (D._weights(h, index.idf) for _, h in items)])
    latent /= D.np.linalg.norm(latent, axis=1, keepdims=True)
    (space,) = index.spaces
    assert len(corpus) == 12_000 and D.np.abs(space.latent @ space.latent.T - latent @ latent.T).max() < 1e-3
