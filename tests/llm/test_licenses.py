import re
import textwrap

from pyspark.sql import functions as F

from calibrix.llm import licenses as li


def test_canonical_form_is_the_same_in_python_and_spark(spark):
    texts = ["The  Licence, “of”\tÜber", "Copyright (c) 2020 X\nCopyright owner\n (C) y\nall rights reserved. no\nA-B", "©", "x" * 100_000, " \n ",
             "ORGANISATION; sub-licence / non-infringement"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", li.canonical(F.col("t")).alias("c"))
    for r in df.collect():
        assert r.c == li.canonical_text(texts[r.i])
    assert li.canonical_text(texts[1]) == "copyright owner a b".replace("copyright owner", "").strip()


def test_texts_are_found_however_set(spark, odd_docs, no_docs):
    mit = li.TEXTS["MIT"]
    reset = "Copyright (c) 2001 Somebody\n\n" + mit.split("\n", 1)[1].replace("\n\n", "\n\n\n  ").upper().replace('"', "'")
    rows = [(1, mit, "x"), (2, reset, "x"), (3, mit + "\nand more", "x"), (4, "a text\n  licensed under CC BY-NC 4.0\nLicensed under the Apache License, "
            "Version 2.0.\nMore", "x"), (5, li.TEXTS["BSD-3-Clause"].replace("license", "licence"), "x")]
    got = {r.doc_id: r for r in li.license_scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()}
    assert [got[i].license for i in range(1, 6)] == ["MIT", "MIT", None, None, "BSD-3-Clause"]
    assert got[4].notices == "Apache-2.0,CC-BY-NC-4.0" and got[3].notices == ""
    assert li.license_scan(odd_docs).count() == odd_docs.count() and li.license_scan(no_docs).count() == 0
    assert {r.license for r in li.license_scan(odd_docs).collect()} == {None}


def test_known_table_of_the_user(spark):
    docs = spark.createDataFrame([(1, "my OWN licence"), (1, "my OWN licence"), (None, None)], "doc_id long, text string")
    known = spark.createDataFrame([(li.digest("My own license!"), "own"), (li.digest("My own license!"), "zzz")], "text_digest string, license string")
    assert sorted((str(r.doc_id), str(r.license)) for r in li.license_scan(docs, known).collect()) == [("1", "own"), ("1", "own"), ("None", "None")]


def test_line_breaks_do_not_matter(spark):
    for name, text in li.TEXTS.items():
        paragraphs = re.split(r"\n[ \t]*\n", text.strip())  # those with a copyright statement stay as they are set
        for width in (*range(20, 140, 3 if len(text) < 5000 else 20), 10_000):
            wrapped = "\n\n".join(p if re.search(r"copyright (\(c\)|\[)", p, re.I) else textwrap.fill(
                " ".join(p.split()), width, break_on_hyphens=False, break_long_words=False) for p in paragraphs)
            assert li.digest(wrapped) == li.digest(text), (name, width)
    usual = li.TEXTS["MIT"].replace("AUTHORS OR\nCOPYRIGHT HOLDERS BE", "\nAUTHORS OR COPYRIGHT HOLDERS BE")
    assert usual != li.TEXTS["MIT"] and "copyright holders be liable" in li.canonical_text(li.TEXTS["MIT"])
    docs = spark.createDataFrame([(1, usual)], "doc_id long, text string")
    assert li.license_scan(docs).first().license == "MIT"


def test_copyright_statements_are_dropped_and_prose_stays(spark):
    said = ["Copyright (c) 2020 X", "Copyright 1999-2001, X", "copyright by X", "(C) 2020 X", "© X", "Copyright <YEAR> <HOLDER>", "Copyright X Foundation",
            "Copyright (c) 1998 The Regents. All\nrights reserved.", "Copyright X\nCopyright Y\n(c) Z\nAll rights reserved."]
    prose = ["copyright notice, this list", "COPYRIGHT HOLDERS BE LIABLE", "copyright", "copyright, patent, trademark", "(c) You must retain"]
    texts = [f"{a}\n\nmid" for a in said] + [f"top\n{a}\nend" for a in prose] + ["Copyright X\n" * 20_000, "Copyright 2020 X\n" * 20_000 + "mid"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", li.canonical(F.col("t")).alias("c"))
    got = {r.i: r.c for r in df.collect()}
    assert [got[i] for i in range(len(texts))] == [li.canonical_text(t) for t in texts]
    assert got[len(texts) - 1] == "mid"
    assert [got[i] for i in range(len(said))] == ["mid"] * len(said)
    assert [got[len(said) + i].split()[1] for i in range(len(prose))] == ["copyright"] * 4 + ["c"]


def test_long_texts_and_headers_are_known(spark):
    apache = li.TEXTS["Apache-2.0"]
    rows = [(name, li.TEXTS[name].replace("\n", "\n  ").upper()) for name in sorted(li.TEXTS)]
    rows += [("Apache-2.0", apache.partition("   END OF")[0]), ("Apache-2.0", apache.replace("http://", "https://")), (None, apache[:9000])]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in li.license_scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [name for name, _ in rows] and len(li.TEXTS) == 20
    assert len({li.digest(v) for t in li.TEXTS.values() for v in li.variants(t)}) == sum(len({li.digest(v) for v in li.variants(t)}) for t in li.TEXTS.values())
    heads = {"Apache-2.0": apache[apache.index("   Licensed under") :].replace("   Lic", " * Lic"), "GPL-2.0": "// SPDX-License-Identifier: GPL-2.0-or-later",
             "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed "
                        "with this\n# file, You can obtain one at https://mozilla.org/MPL/2.0/."}
    docs = spark.createDataFrame([(i, f"{h}\ncode") for i, h in enumerate(heads.values())], "doc_id long, text string")
    assert {r.doc_id: r.notices for r in li.license_scan(docs).collect()} == dict(enumerate(heads))


def test_any_number_of_statements_is_dropped(spark):
    """Unmarked statements below a marked one, however many; no count has another canonical form than the next."""
    mit = li.TEXTS["MIT"].split("\n", 1)[1]
    texts = ["MIT License\n\nCopyright (c) 2020 X\n" + "Copyright Y and others\n" * n + "\n" + mit for n in (0, 1, 99, 100, 101, 1000, 50_000)]
    assert {li.canonical_text(t) for t in texts} == {li.canonical_text(li.TEXTS["MIT"])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.license for r in li.license_scan(docs).collect()} == {"MIT"}


def test_lines_with_a_word_of_a_notice_are_all_that_can_match():
    for lines in li.NOTICES.values():
        for line in lines:
            for said in (line, line.upper(), line.replace("icense", "icence"), f"  * {line}!", line.replace(" ", "\t")):
                assert li.digest(said) == li.digest(line) and any(w in said.lower() for w in li.notice_words())
