import random
import zlib

from terrakiln.llm import langid as L

SYLLABLES = {"en": "the and ing er on th st re ou".split(), "fr": "le eau aux é tre ment ou que".split(), "de": "ung sch ein der ich ä keit ge".split()}


def text(lang, seed, n=80):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def rows(n=240):
    langs = sorted(SYLLABLES)
    return [(i, text(langs[i % 3], i, 5 + i % 90), langs[i % 3], "s") for i in range(n)]


def test_held_out_accuracy(documents):
    df = documents(rows())
    out = (L.fold(df["doc_id"], 3) == 1)
    found = {r.doc_id: r for r in L.identify(df, df.where(~out).select("doc_id", "text", "lang")).collect()}
    held = [r for r in rows() if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(found[d].lang_pred == lang for d, _, lang, _ in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values())


def test_odd_rows(odd, odd_rows, empty):
    found = L.identify(odd, odd.select("doc_id", "text", "lang")).collect()
    assert len(found) == len(odd_rows)
    assert {r.doc_id for r in found if r.lang_pred == L.UNKNOWN} == {1, 2, 7}
    assert all(r.rejected and r.score == 0 for r in found if r.lang_pred == L.UNKNOWN)
    assert L.identify(empty, empty.select("doc_id", "text", "lang")).count() == 0
    unlabelled = L.identify(odd, empty.select("doc_id", "text", "lang")).collect()
    assert {r.lang_pred for r in unlabelled} == {L.UNKNOWN}


def test_stage_keeps_columns_and_clean_rows(documents):
    df = documents([*rows(), (900, None, "en", "s"), (901, "12 34 ...", "en", "s")])
    kept = L.keep_identified(df, df.select("doc_id", "text", "lang"))
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {900, 901}
    assert len(ids) > 0.95 * 240


def test_every_label_is_learned(documents):
    df = documents([(i, text(sorted(SYLLABLES)[i % 3], i), f"l{i // 2}", "s") for i in range(1200)])
    learned = L.learn(df.select("doc_id", "text", "lang"), all_bytes=600 * 900)
    assert len(learned) == 600
    assert all(0 < len(d) <= 900 for d in learned.values())


def test_against_plain_compression():
    """The label is that of the least sum of plain compressed sizes, block by block."""
    import zstandard

    dictionaries = {k: text(k, 1, 2000).encode() for k in SYLLABLES}
    model = L.Identifier(dictionaries)

    def size(label, block):
        own = zstandard.ZstdCompressionDict(dictionaries[label], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        frame = lambda raw: len(zstandard.ZstdCompressor(level=L.LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw))
        return frame(block) - frame(b"") + 1

    for i in range(40):
        words = " ".join(L._LETTERS.findall(text(sorted(SYLLABLES)[i % 3], 100 + i, 5 + 70 * i).lower()))
        blocks = [words[a : a + L.BLOCK].encode() for a in range(0, len(words), L.BLOCK)]
        sums = sorted((sum(size(k, b) for b in blocks), k) for k in SYLLABLES)
        label, score, rejected = model.predict(words)
        assert (label, rejected) == (sums[0][1], score < L.MARGIN)
        assert abs(score - (1 - sums[0][0] / sums[1][0])) < 1e-12


def test_end_of_a_long_text_counts():
    model = L.Identifier({k: text(k, 1, 3000).encode() for k in SYLLABLES})
    mixed = text("fr", 2, 2000) + " " + text("de", 3, 6000)
    assert model.predict(mixed)[0] == "de"
    assert model.predict(mixed)[1] < model.predict(text("de", 3, 8000))[1]


def test_a_corpus_of_one_language_or_none_is_kept(documents):
    for lang in ("en", None):
        df = documents([*((i, text("en", i, 5 + i), lang, "s") for i in range(60)), (900, None, lang, "s"), (901, "12 34 ...", lang, "s")])
        learn_from = df.select("doc_id", "text", "lang")
        assert {r.doc_id for r in L.keep_identified(df, learn_from).collect()} == set(range(60))
        assert {r.doc_id for r in L.identify(df, learn_from).collect() if r.rejected} == {900, 901}
