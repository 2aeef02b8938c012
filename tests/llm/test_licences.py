"""Licences without a template are unknown, families stay families, prose with licence words is none."""

import re
import time

from pyspark.sql import functions as F

from polyglossa.llm import licences

UNLISTED = [
    "Licensed under the EUPL, Version 1.2 or later.",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: EUPL-1.2",
    "This program is free software; you may redistribute it under the terms of the Artistic License.",
    "This work is licensed under the Open Data Commons Attribution License.",
    "Licensed under the Foo Corporation Proprietary Software Agreement, granting permission to deal in the Software.",
]
LISTED = {"SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: Apache-2.0": "Apache", "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL", "SPDX-License-Identifier: BSD-3-Clause": "BSD", "SPDX-License-Identifier: ISC": "ISC"}
PROSE = [
    "The council licensed the new bar under strict conditions.",
    "All software at the school is free, and no licence is needed to use the library.",
    "The copyright of the song was sold by the band in 1990 to a firm from London.",
    "He asked for permission to use, for any purpose, the hall next to the church.",
    "There is no warranty of any kind on used cars in this town.",
]


def test_unlisted_licences(spark):
    plain = [f"Day {i} was calm, and the {w} went home before the rain came." for i, w in enumerate(["farmer", "teacher", "sailor", "baker"] * 25)]
    texts = [*UNLISTED, *LISTED, *PROSE, *plain, None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {texts[r.doc_id]: r for r in licences.scan_documents(rows).collect()}
    assert [(found[t].licence, found[t].confirmed) for t in UNLISTED] == [("unknown", False)] * len(UNLISTED)
    assert {t: found[t].licence for t in LISTED} == LISTED
    assert not [t for t in (*PROSE, *plain, None, "") if found[t].licence is not None]
    assert all(found[t].n_paragraphs == 1 and 0 < found[t].probability <= 1 for t in (*UNLISTED, *LISTED))


#: Pieces of licences without any licence word.
BARE = {
    "to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction": "MIT",
    "This program is free software: you can modify it under the terms of the GNU General Public version 3": "unknown",
}


def test_windows_without_licence_words(spark):
    plain = [f"Day {i} was calm, and the {w} went home before the rain came." for i, w in enumerate(["farmer", "teacher", "sailor", "baker"] * 25)]
    long = " ".join(["the rain came and the farmer went home"] * 4)
    texts = [*BARE, *(f"{long} {t} {long}" for t in BARE), *plain]
    assert not any(re.search(licences.CUES, t) for t in texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {texts[r.doc_id]: r.licence for r in licences.scan_documents(rows).collect()}
    assert not [t for t in texts[: 2 * len(BARE)] if found[t] is None]
    assert {t: found[t] for t in BARE} == BARE
    assert not [t for t in plain if found[t] is not None]


def test_windows_of_long_paragraph(spark):
    """A paragraph's words are cut once, not again for each of its windows."""
    text = " ".join(f"word{i}" for i in range(60_000))
    frame = spark.createDataFrame([(text,)], "t string").select(licences._windows(F.col("t")).alias("w"))
    began = time.time()
    windows = frame.first().w
    assert time.time() - began < 15
    assert len(windows) == 1499 and windows[1].split()[0] == "word40" and windows[-1].split()[-1] == "word59999"


def test_seen_windows(spark):
    """Masked windows: words in any case, | in the text, letters beyond ASCII, own trigrams only beside a template's."""
    texts = ["Of THE people, by the sea", "x|of the|y", "éof the", "out of\n\nthe box", "Grüße, under the GNU lesser general public licence!", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    rows = frame.select(licences._seen(F.translate(F.lower("t"), "|", "/")).alias("s")).collect()
    assert [[(w.mask, w.n_own) for w in r.s] for r in rows] == [
        [("of the | by the |", 0)], [("| of the |", 0)], [], [], [("| under the gnu lesser general public |", 6)], [],
    ]
