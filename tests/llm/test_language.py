import zlib

import numpy as np
import pytest

from emberlog.llm import language

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return language.learn(docs.where(~language.held_out()))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs, model).collect()
    assert all(bool(zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == h for r, h in zip(got, [x[0] for x in docs.select(language.held_out()).collect()], strict=True))
    out = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang]
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_viterbi_is_best_path(model):
    r = np.random.default_rng(0)
    score = r.normal(0, 4, (12, 3)).astype(np.float32)
    labeller = language.Labeller(language.Model(["a", "b", "c"], np.ones((language.BUCKETS, 3)), np.ones((len(language.SCRIPT_NAMES), 3))), 3.0)
    for n in (np.array([5, 0, 7]), np.array([12])):
        label = labeller.viterbi(score, np.arange(12), n)
        at = 0
        for size in n:
            part = score[at : at + size]

            def worth(path, part=part):
                return sum(part[k, s] for k, s in enumerate(path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

            if size:
                paths = np.array(np.meshgrid(*[range(3)] * size)).reshape(size, -1).T if size <= 7 else None
                if paths is not None:
                    assert worth(label[at : at + size]) == pytest.approx(max(map(worth, paths)), abs=1e-3)
            at += size


def test_spans_nulls_and_scripts(spark, model):
    english = "The thing that they were in the house of the other and with the king "
    french = "les maisons de la reine et un autre que le roi est dans une ville "
    rows = [(1, english * 3 + french * 3, "zz"), (2, None, "zz"), (3, "123 ...", "zz"), (4, "", None), (None, "привет мир", "zz"), (5, "漢字", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language.identify(df, model, spans=True).collect()}
    assert [s.lang for s in got[1].lang_spans] == ["en", "fr"]
    assert abs(got[1].lang_spans[1].start - len(english * 3)) < 12
    assert {got[k].lang_pred for k in (2, 3, 4)} == {"und"} and got[2].score == 0
    assert got[None].lang_pred in model.languages and got[5].lang_pred in model.languages
    empty = language.learn(df.where("false").withColumn("lang", df.text))
    assert {r.lang_pred for r in language.identify(df, empty).collect()} == {"und"}
    assert language.identify(df.limit(0), model).count() == 0


def naive(model, text, switch=language.SWITCH):
    """The predicted language of one text, word by word."""
    import regex

    words = [w.lower() for w in regex.findall(r"\p{L}+", text or "")]
    if not words:
        return "und", 0.0
    best, back = None, []
    for w in words:
        points, sizes, script = language.spelled([w])
        bucket, _ = language.gram_buckets(points, sizes)
        score = model.table[bucket].astype(float).sum(axis=0) / len(language.GRAMS)
        score = np.maximum(score, score.max() - 30)
        score[~model.allowed[script[0]]] = -1000
        if best is None:
            best = score
            continue
        jump = best.max() - switch
        back.append([k if best[k] >= jump else int(best.argmax()) for k in range(len(best))])
        best = np.maximum(best, jump) + score
    state = [int(best.argmax())]
    for step in reversed(back):
        state.append(step[state[-1]])
    letters = np.zeros(len(best))
    for w, s in zip(words, reversed(state), strict=True):
        letters[s] += len(w)
    return model.languages[int(letters.argmax())], letters.max() / letters.sum()


def test_predictions_like_a_plain_version(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text[:3000] if r.text else r.text) for r in docs.collect()] + [(10_000, "Straße İstanbul 中文 the house"), (10_001, "ÅÅ le la les of the")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        lang, share = naive(model, text)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(share, abs=1e-6)


def test_very_long_text_and_clashing_columns(spark, model):
    text = "the house of the king and the river " * 30_000
    df = spark.createDataFrame([(1, text, "p", 2.0, 5), (2, None, "p", 2.0, 5)], "doc_id long, text string, lang_pred string, score double, label int")
    got = {r.doc_id: r for r in language.identify(df, model, spans=True).collect()}
    assert got[1].lang_pred == "en" and got[1].label == 5 and got[1].lang_spans[0].start == 0 and got[1].lang_spans[-1].end == len(text) - 1
    assert got[2].lang_pred == "und" and got[2].lang_spans == []
