"""Language detection by frequent words against a plain version."""

import re

from pyspark.sql import functions as F

from postrider.functions import language


def test_a_text_is_split_once_and_odd_texts_are_judged_as_before(spark):
    odd = [None, "", " the of and ", "the of and " * 3, "the of " + " \n" * 400 + "and to in is that for", "a" * 19, "the  of\t\tand  to x  ", "see HTTPS://www.de/der/die/das der die das und nicht ein",
           "es der des est av " * 8, "the of and der die das " * 5, "www." + "the " * 9, "ÎLE ΣΑΣ THE OF AND İS más también ØG PÅ SOM TIL"]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, text string").select("i", language.detect(F.col("text")).alias("lang"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1

    def plain(text):
        clean = re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub(r"(?:https?://|www\.)[^ \t\n\x0b\f\r]+", " ", text, flags=re.I)).strip(" ")
        words = re.findall(r"\w+", clean.lower())
        counts = [(sum(w in own for w in words), lang) for lang, own in language.FREQUENT.items()]
        n, lang = max(counts)
        return lang if len(clean) >= language.MIN_CHARS and n > 0 and n >= language.MIN_SHARE * sum(c for c, _ in counts) else None

    assert {r.i: r.lang for r in rows.collect()} == {i: None if t is None else plain(t) for i, t in enumerate(odd)}
