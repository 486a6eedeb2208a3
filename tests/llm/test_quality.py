import re
from collections import Counter

from pyspark.sql import functions as F

from tussis.llm import quality

CLEAN = "This is a plain sentence with some words. Here comes another one.\n\nA third line closes the text properly."
NAV = "Home | About | Contact | Products | News | Help |"
ROWS = [
    (1, CLEAN, "en"), (1, CLEAN, "en"), (2, NAV + "\n" + NAV, "en"), (3, CLEAN + "\n" + NAV + "\nAll rights reserved.", "en"), (4, None, "en"), (5, "", "en"), (6, "Too short.", "en"),
    (7, "again and again and again and again and again and again and again.", "en"), (None, "Of%%% athe*** erntw.%%% Thnt&&& ndr$$$ one two three four five six", "en"),
    (8, " ".join(f"这是第{i}个句子。" for i in range(12)), "zh"), (9, "\x1c\x85 odd\xa0spaces here. " * 3 + " ".join(f"w{i}." for i in range(30_000)), "xx"),
]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    inside = {i + j for i, w in enumerate(windows) if w in often for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_figures_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(1000 + k, t) for k, (_, t, _) in enumerate(ROWS)], "doc_id bigint, text string")
    whole = docs.unionByName(odd)
    want = {r.doc_id: brute(r.text or "") for r in whole.collect()}
    got = quality.quality_report(whole).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in got} == want
    assert all(not r.kept for r in got if r.base_failed)


def test_lines_and_verdicts(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, kept string").withColumn("n_chars", F.length("text"))
    cleaned = quality.clean(df)
    assert cleaned.columns == df.columns
    rows = {r.doc_id: r for r in cleaned.collect()}
    assert set(rows) == {1, 3, 8, 9} and cleaned.filter("doc_id = 1").count() == 2
    assert rows[1].text == rows[3].text == CLEAN and rows[3].n_chars == len(CLEAN)
    assert rows[9].text == ROWS[10][1]


def test_rows_and_empty_table(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, n_words string")
    assert quality.quality_report(df).count() == len(ROWS)
    assert quality.quality_report(df.limit(0)).count() == 0 and quality.clean(df.limit(0)).count() == 0


def test_clean_documents_of_other_scripts_and_long_lines_stay(spark):
    prose, more = (" ".join(f"Sentence {i} tells something new about item{i}." for i in range(a, a + 40)) for a in (0, 40))
    footer = "All rights reserved. Read our privacy policy, the terms of use and the cookie policy before you go on."
    marks = {"km": "ប្រយោគទី{i} ល្អ។", "my": "စာကြောင်း{i} ကောင်း။", "bo": "ཚིག{i} ཡག་པོ།", "th": "ประโยคภาษาไทยที่{i} ดีมาก", "lo": "ປະໂຫຍກພາສາລາວ{i} ດີຫຼາຍ"}
    texts = {name: "\n".join(t.format(i=i) for i in range(12)) for name, t in marks.items()}
    texts |= {"mention": prose + " Our privacy policy is short. " + more, "footer": prose + "\n" + footer, "only footer": "\n".join([footer] + [f"Sign in to shop {i}." for i in range(9)])}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    rows = {r.doc_id: r.text for r in quality.clean(df).collect()}
    assert set(rows) == {*texts} - {"only footer"}
    assert rows["footer"] == prose and all(rows[n] == texts[n] for n in [*marks, "mention"])


def test_boilerplate_pattern_says_the_same():
    word, phrase = "word ", "terms of use cookies "
    for before in (0, 14, 15, 16):
        for between in (0, 15, 16):
            for after in (0, 15, 16):
                line = word * before + phrase + word * between + "Back to top. " + word * after
                assert quality.is_boilerplate(line) == bool(quality.BOILERPLATE.search(line)), (before, between, after)
    assert not quality.is_boilerplate(word * 9) and quality.is_boilerplate("We use cookies to improve our site.")
