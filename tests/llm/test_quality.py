import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from terrakiln.llm import quality as Q


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    seen, again = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), again, len(marked)


@given(st.text(st.sampled_from("ab \n#é\xa0\t日"), max_size=200))
@settings(max_examples=300, deadline=None)
def test_base_counts(text):
    raw = text.encode()
    assert Q.base_counts(text, raw, raw.split())[:5] == brute(text)


def test_odd_rows(odd, odd_rows, empty):
    got = sorted(((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in Q.judge(odd).collect()), key=str)
    assert got == sorted(((d, brute(t)) for d, t, *_ in odd_rows), key=str)
    assert Q.judge(empty).count() == 0


def test_junk_goes_and_clean_text_stays(documents):
    import random

    r = random.Random(3)
    word = lambda: r.choice("the and of to in a house river morning people water light garden story small green".split())
    clean = [(i, "\n".join(" ".join(word() + str(r.choice(["", "s", "ly"])) for _ in range(9)).capitalize() + "." for _ in range(8 + i % 5)), "en", "s") for i in range(300)]
    junk = [(1000 + i, "\n".join(" ".join(f"{word()}{x}### $%" for x in range(6)) for _ in range(12)), "en", "s") for i in range(60)]
    found = {x.doc_id: x for x in Q.judge(documents(clean + junk)).collect()}
    assert sum(found[d].kept for d, *_ in clean) >= 0.98 * len(clean)
    assert sum(found[d].kept for d, *_ in junk) == 0
    assert not any(x.kept and x.base_failed for x in found.values())
