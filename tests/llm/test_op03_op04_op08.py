import itertools
import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from linkloom.llm import op03_audio as audio
from linkloom.llm import op04_classifier as quality
from linkloom.llm import op08_toxicity as tox
from linkloom.llm import text as tx
from tests.llm.helpers import edge_docs, edge_rows, empty_docs, prose


def wav(samples, rate=16_000, bits=16, channels=1):
    data = {8: lambda x: (np.round(x * 127) + 128).astype(np.uint8), 16: lambda x: np.round(x * 32767).astype("<i2"), 32: lambda x: np.round(x * 2147483000).astype("<i4")}[bits](np.asarray(samples, np.float64)).tobytes()
    size = bits // 8 * channels
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * size, size, bits) + b"data" + struct.pack("<I", len(data)) + data


@pytest.mark.parametrize("rate,target", [(44_100, 16_000), (8_000, 16_000), (48_000, 16_000), (22_050, 16_000)])
def test_resampling_against_brute_force(rate, target):
    x = np.random.default_rng(1).normal(size=3000).astype(np.float32)
    up, down = target // np.gcd(rate, target), rate // np.gcd(rate, target)
    bank = audio.phases(int(up), int(down), 8)
    half = bank.shape[1] // 2
    for signal in (x, x[:40], x[:1]):
        got = audio.resample(signal, rate, target, 8)
        assert len(got) == -(-len(signal) * up // down)
        for n in {0, len(got) // 2, len(got) - 1}:
            at = n * down // up - half + 1
            want = sum(bank[n * down % up][j] * (signal[at + j] if 0 <= at + j < len(signal) else 0) for j in range(2 * half))
            assert abs(got[n] - want) < 1e-4
    tone = np.sin(2 * np.pi * 440 * np.arange(rate) / rate).astype(np.float32)
    out = audio.resample(tone, rate, target, 8)
    assert abs(out - np.sin(2 * np.pi * 440 * np.arange(len(out)) / target))[300:-300].max() < 2e-3


def test_mel_frames_against_brute_force():
    rules = audio.Rules()
    x = np.random.default_rng(2).normal(size=1234).astype(np.float32)
    mel, energy = audio.spectrum(x, rules)
    assert mel.shape == (1 + -(-(1234 - 400) // 160), 40)
    k = 3
    frame = x[k * 160 : k * 160 + 400]
    power = abs(np.fft.rfft(frame * np.hanning(401)[:-1], 512)) ** 2
    assert np.allclose(mel[k], np.log(power @ audio.filterbank(16_000, 512, 40) + 1e-6), atol=1e-3) and abs(energy[k] - 10 * np.log10((frame**2).mean())) < 1e-3
    bank = audio.filterbank(16_000, 512, 40)
    assert (bank >= 0).all() and (bank.sum(axis=0) > 0).all() and (np.diff(bank.argmax(axis=0)) >= 0).all()


def test_hysteresis_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(50):
        energy = rng.normal(size=60)
        on, spans = False, []
        for k, e in enumerate([*energy, -99]):
            if not on and e >= 0.8:
                on, begin = True, k
            elif on and e < -0.3:
                on = False
                spans.append((begin, k))
        assert audio.segments(energy, 0.8, -0.3, 2) == [s for s in spans if s[1] - s[0] >= 2]


def test_wave_files_tensors_and_spans(spark, tmp_path):
    loud = np.concatenate([np.zeros(16_000), np.sin(np.arange(16_000) * 0.3), np.zeros(16_000)])
    rows = [(1, wav(loud)), (2, wav(np.repeat(loud, 2), channels=2)), (3, wav(loud[:8000], bits=8)), (4, wav(loud, 44_100, 32)), (5, None), (6, b""), (7, b"RIFF\x01\x02\x03\x04WAVEjunk"), (8, wav([])), (None, b"\x80")]
    media = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in rows], "doc_id long, sound binary")
    out = audio.audio(media, "sound")
    got = out.orderBy("doc_id", "part").collect()
    own = [r for r in got if r.doc_id == 1]
    assert [r.part for r in own] == [0, 1, 2] and [r.frames for r in own] == [100, 100, 99] and abs(own[-1].end_s - 3.0) < 1e-9
    (segment,) = [s for r in own for s in r.segments]
    assert abs(segment.begin_s - 1) < 0.03 and abs(segment.end_s - 2) < 0.03
    two = [r for r in got if r.doc_id == 2]
    assert [r.tensor for r in two] == [r.tensor for r in own]  # both channels are the same
    assert all(len(r.tensor) == 4000 for r in got if r.frames) and all(abs(x - np.log(1e-6)) < 1e-4 for x in own[-1].tensor[99 * 40 :])
    assert sorted(str(r.doc_id) for r in got if not r.frames) == ["5", "6", "7", "8"] and all(r.tensor is None and r.end_s == 0 for r in got if not r.frames)
    assert [r.frames for r in got if r.doc_id is None] == [1]
    assert {r.doc_id: r.error for r in got if r.error} == {6: "empty", 7: "unreadable", 8: "no samples"} and next(r for r in got if r.doc_id == 5).error is None
    table = audio.fixed_shape(out.toArrow())
    kind = table.schema.field("tensor").type
    assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [100, 40]
    written = audio.store(out, str(tmp_path / "tensors")).collect()
    assert sum(r.rows for r in written) == len(got)
    import pyarrow.parquet as pq

    back = pq.read_table(written[0].file)
    assert isinstance(back.schema.field("tensor").type, pa.FixedShapeTensorType)


def test_audio_edges(spark):
    got = audio.audio(edge_docs(spark), "text").collect()
    assert all(r.frames for r in got if r.part) and sum(r.part == 0 for r in got) == len(edge_rows())
    assert sum(r.frames == 0 for r in got) == 3
    assert audio.audio(empty_docs(spark), "text").count() == 0


def test_statistics_against_brute_force():
    texts = ["The the Cat!! 12\n\nAB cd. é\nthe", "", None, "x" * 50 + "\nx"]
    got = np.concatenate([quality.statistics(p) for p in tx.slices(pa.array(texts))])
    at = quality.STATISTICS.index
    for row, text in zip(got, texts):
        text = text or ""
        words, lines, n = text.split(), [x for x in text.split("\n") if x], len(text.encode())
        if not n:
            assert not row.any()
            continue
        low = [w.lower() for w in words]
        assert row[at("log_words")] == pytest.approx(np.log1p(len(words))) and row[at("log_chars")] == pytest.approx(np.log1p(n))
        assert row[at("distinct_words")] == pytest.approx(len(set(low)) / len(low)) and row[at("common_word")] == pytest.approx(max(low.count(w) for w in low) / len(low))
        assert row[at("upper")] == pytest.approx(sum("A" <= c <= "Z" for c in text) / n) and row[at("digit")] == pytest.approx(sum(c.isdigit() for c in text) / n)
        assert row[at("distinct_lines")] == pytest.approx(len(set(lines)) / len(lines)) and row[at("short_lines")] == pytest.approx(sum(len(x.encode()) < 40 for x in lines) / len(lines))
        assert row[at("symbol_words")] == pytest.approx(sum(w[-1] in "!#$%&*+/<=>?@[\\]^_`{|}~" for w in words) / len(words))


def test_isotonic_regression_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        counts = rng.integers(0, 4, 12)
        sums = np.array([rng.integers(0, c + 1) for c in counts])
        if not counts.sum():
            continue
        got = quality.isotonic(sums.astype(float), counts.astype(float))
        used = np.flatnonzero(counts)
        mean = sums[used] / counts[used]
        for k, b in enumerate(used):  # the max-min formula
            want = max(min(sums[used[i : j + 1]].sum() / counts[used[i : j + 1]].sum() for j in range(k, len(used))) for i in range(k + 1))
            assert got[b] == pytest.approx(want)
        assert (np.diff(got) >= -1e-12).all() and len(got) == 12 and len(mean)


def test_cosines_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(6)
    side = len(quality.STATISTICS)
    model = quality.Model(np.zeros(side), np.ones(side), rng.normal(size=(side, 20_000)) / 3, rng.uniform(0, 2 * np.pi, 20_000), np.zeros(20_001), np.zeros(0), np.zeros(1))
    x = rng.normal(size=(6, side))
    z = model.cosines(x)
    assert np.allclose(z @ z.T, np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 18), atol=0.03)


def test_classifier_on_held_out_documents(spark):
    docs = [(k, prose(k, 60 + k % 90) if k % 4 else " ".join([prose(k, 3)] * 25), "en", "s", 1) for k in range(1200)]
    labels = [(k, int(k % 4 > 0), 0) for k in range(800)] + [(None, 1, 0), (5, None, 0), (99_999, 0, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.scored(df, marks).collect()}
    right = [out[k].keep == (k % 4 > 0) for k in range(800, 1200)]
    assert sum(right) >= 0.97 * len(right) and all(0 <= r.probability <= 1 for r in out.values())
    assert {r.doc_id for r in quality.accepted(df, marks).collect()} == {k for k, r in out.items() if r.keep}


def test_classifier_edges(spark):
    docs = edge_docs(spark)
    marks = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 17)] * 3, "doc_id long, quality int, toxic int")
    assert quality.scored(docs, marks).count() == len(edge_rows()) and quality.accepted(docs, marks).schema == docs.schema
    for none in (marks.limit(0), marks.where("quality = 1")):
        assert all(r.keep and r.score is None and r.probability is None for r in quality.scored(docs, none).collect())
    assert quality.scored(empty_docs(spark), marks).count() == 0 and quality.accepted(empty_docs(spark), marks).count() == 0


def test_chain_against_brute_force():
    rng = np.random.default_rng(7)
    for n in (1, 2, 9, 64, 130):
        scores, moves, start = rng.normal(size=n) * 2, rng.normal(size=(2, 2)), float(rng.normal())
        first = rng.random(n) < 0.2
        first[0] = True
        got = tox.marginals(scores, first, moves, start)
        begins = [*np.flatnonzero(first), n]
        for a, b in zip(begins, begins[1:]):
            size = b - a
            alpha, beta = np.zeros((size, 2)), np.ones((size, 2))
            for k in range(size):
                e = np.array([1, np.exp(scores[a + k])])
                alpha[k] = e * (np.array([1, np.exp(start)]) if k == 0 else alpha[k - 1] @ np.exp(moves))
                alpha[k] /= alpha[k].sum()
            for k in reversed(range(size - 1)):
                beta[k] = np.exp(moves) @ (np.array([1, np.exp(scores[a + k + 1])]) * beta[k + 1])
                beta[k] /= beta[k].sum()
            p = alpha * beta
            assert np.allclose(got[a:b], p[:, 1] / p.sum(axis=1), atol=1e-9)


BAD = ["blarg", "zonkish", "frubbed"]


def insulted(k):
    pick = random.Random(k)
    words = prose(k, 100).split()
    for _ in range(4):
        words.insert(pick.randrange(len(words)), pick.choice(BAD))
    return " ".join(words)


def test_toxic_documents_and_spans(spark):
    docs = [(k, insulted(k) if k % 5 == 0 else prose(k, 100), "en", "s", 1) for k in range(700)] + [(900, prose(900, 50) + " été, BLARG blarg! " + prose(901, 50), "en", "s", 1), (901, None, "en", "s", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(400)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in tox.scored(df, marks).collect()}
    held = range(400, 700)
    assert sum(out[k].toxic for k in held if k % 5 == 0) >= 57 and not any(out[k].toxic for k in held if k % 5)
    text = {d: t for d, t, *_ in docs}
    assert [text[900][s.begin : s.end] for s in out[900].spans] == ["BLARG blarg"]
    assert out[901].spans == [] and out[901].words == 0 and not out[901].toxic
    for k in range(0, 50, 5):
        assert {text[k][s.begin : s.end] for s in out[k].spans} <= {w for w in BAD} | {f"{a} {b}" for a in BAD for b in BAD} | {f"{a} {b} {c}" for a in BAD for b in BAD for c in BAD}
    assert {r.doc_id for r in tox.toxic(df, marks).collect()} == {k for k, r in out.items() if r.toxic}


def test_toxicity_edges(spark):
    docs = edge_docs(spark)
    marks = spark.createDataFrame([(k, 1, k % 2) for k in range(1, 17)] * 2, "doc_id long, quality int, toxic int")
    assert tox.scored(docs, marks).count() == len(edge_rows())
    for none in (marks.limit(0), marks.where("toxic = 0")):
        assert all(r.score is None and not r.toxic for r in tox.scored(docs, none).collect())
    assert tox.scored(empty_docs(spark), marks).count() == 0


def test_wave_of_24_bits_floats_and_extensible_headers():
    want = np.array([0.0, 0.5, -0.5, 0.25, -1.0, 0.125])
    whole = (want * (1 << 23)).astype("<i4")
    three = b"".join(int(x).to_bytes(3, "little", signed=True) for x in whole)

    def wave(kind, bits, data, sub=None, channels=1):
        head = struct.pack("<HHIIHH", kind if sub is None else 0xFFFE, channels, 8000, 8000 * channels * bits // 8, channels * bits // 8, bits)
        head += b"" if sub is None else struct.pack("<HHIH", 22, bits, 0, sub) + bytes.fromhex("000000001000800000aa00389b71")
        return b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data

    cases = [(1, 24, three), (3, 32, want.astype("<f4").tobytes()), (3, 64, want.astype("<f8").tobytes()), (1, 16, (want * (1 << 15)).astype("<i2").tobytes())]
    for kind, bits, data in cases:
        for sub in (None, kind):
            got, rate = audio.samples(wave(kind, bits, data, sub), 1)
            assert rate == 8000 and np.allclose(got, want, atol=1e-6), (kind, bits, sub)
    got, _ = audio.samples(wave(1, 24, three, 1, channels=2), 1)
    assert np.allclose(got, want.reshape(-1, 2).mean(axis=1), atol=1e-6)
    assert len(audio.samples(wave(2, 4, three), 1)[0]) == 0 and len(audio.samples(wave(1, 24, three, 2), 1)[0]) == 0
    odd = np.array([np.nan, np.inf, -np.inf, 3], "<f4").tobytes()
    assert audio.samples(wave(3, 32, odd), 1)[0].tolist() == [0, 1, -1, 1]


def _part(seed, texts=12):
    pick = np.random.default_rng(seed)
    made = [" ".join(pick.choice(["idiot", "fine", "Stone", "x9", "über", "walking", "walker"], size=int(pick.integers(1, 9)))) for _ in range(texts)]
    piece = next(iter(tx.slices(pa.array(made))))
    own = tox.words(piece)
    known = np.unique(own.codes[own.codes != 0])
    part = tox.part(piece, pick.random(piece.count) < 0.5, known[::2], np.unique(own.codes[:8, 0]))
    return part, len(known[::2]) + 7


def test_likelihood_and_gradient_against_finite_differences_and_all_taggings():
    part, size = _part(4)
    rng = np.random.default_rng(5)
    w = rng.normal(size=size) * 0.5
    w[-7] = 0
    value, gradient = tox.likelihood(part, w)
    # All taggings of all texts.
    s = tox.scores(part, w[:-6]) + w[-6]
    begins = [*np.flatnonzero(part.first), len(part.first)]
    moves, want = w[-5:-1].reshape(2, 2), 0.0
    for a, b in zip(begins, begins[1:]):
        def of(tags, a=a):
            return w[-1] * tags[0] + sum(s[a + k] * t for k, t in enumerate(tags)) + sum(moves[x, y] for x, y in zip(tags, tags[1:]))
        want += of([int(x) for x in part.label[a:b]]) - np.log(sum(np.exp(of(t)) for t in itertools.product((0, 1), repeat=b - a)))
    assert np.isclose(value, want)
    for k in np.delete(np.arange(size), size - 7):
        step = np.zeros(size)
        step[k] = 1e-5
        slope = (tox.likelihood(part, w + step)[0] - tox.likelihood(part, w - step)[0]) / 2e-5
        assert np.isclose(gradient[k], slope, atol=1e-4), k


def test_ascent_finds_the_maximum():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(30, 8))
    y = rng.normal(size=30)
    found = tox.maximise(lambda w: (-float(((a @ w - y) ** 2).sum()) / 2, -a.T @ (a @ w - y)), np.zeros(8), 40, 0.5)
    assert np.allclose(found, np.linalg.solve(a.T @ a + 0.5 * np.eye(8), a.T @ y), atol=1e-3)


def test_one_toxic_passage_in_a_very_long_document(spark):
    docs = [(k, insulted(k) if k % 5 == 0 else prose(k, 100)) for k in range(400)]
    docs += [(500, prose(500, 9000) + " " + " ".join(insulted(k) for k in range(600, 606)) + " " + prose(501, 9000)), (501, prose(502, 18_000)), (0, insulted(0)), (0, insulted(0))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in tox.scored(df, marks).collect()}
    assert out[500].toxic and len(out[500].spans) >= 15 and not out[501].toxic


def test_normal_equations_against_a_direct_solution(spark):
    docs = spark.createDataFrame([(k, prose(k, 20 + k % 60) + (" !!!" * (k % 7) if k % 2 else "")) for k in range(240)], "doc_id long, text string").repartition(6)
    marks = spark.createDataFrame([(k, k % 2) for k in range(240)], "doc_id long, quality int")
    rules = quality.Rules(features=24)
    stats = quality.measured(docs)
    model = quality.fit(stats, marks, rules)
    rows = stats.selectExpr("doc_id", "stats", f"pmod(xxhash64(doc_id), 100) < {rules.held} as held").collect()
    x = np.array([r.stats for r in rows if not r.held])
    y = np.array([r.doc_id % 2 for r in rows if not r.held], float)
    assert np.allclose(model.mean, x.mean(axis=0)) and 0 < len(x) < 240
    z = np.concatenate([model.cosines(x), np.ones((len(x), 1))], axis=1)
    penalty = np.eye(25) * rules.ridge * len(x)
    penalty[-1, -1] = 0
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-6)


def test_a_labelled_id_that_many_rows_share_counts_once(spark):
    texts = [(k, prose(f"c{k}", 60) + (" zapfool " + prose(f"d{k}", 5)) * 3 * (k % 2), k % 2 > 0) for k in range(80)]
    df = spark.createDataFrame([(k, t) for k, t, _ in texts], "doc_id long, text string")
    marks = spark.createDataFrame([(k, y) for k, _, y in texts], "doc_id long, toxic boolean")
    more = spark.range(3000).selectExpr("1L as doc_id", "concat('never ', id) as text")
    once, many = tox.fit(df, marks), tox.fit(df.where("doc_id != 1").unionByName(more), marks)
    assert abs(many.rates[0] - once.rates[0]) < 0.02 and len(many.codes) > 0
    assert np.array_equal(tox.fit(df.unionByName(df), marks).codes, once.codes)
