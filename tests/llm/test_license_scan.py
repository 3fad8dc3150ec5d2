import random

from sparrowmill.llm import license_scan

MIT, ISC = license_scan.TEXTS["MIT"][0], license_scan.TEXTS["ISC"][0]


def test_variants_have_the_same_digest(table):
    texts = [
        MIT, "Copyright (c) 2020 Some One\n\n" + MIT.upper(), MIT.replace(" ", "\n   "), MIT.replace("MERCHANTABILITY", "MERCHANTIBILITY").replace("NONINFRINGEMENT", "NON-INFRINGEMENT"),
        "© 2019 A B\n(c) 2020 C D\n" + ISC, MIT + " and one more clause", MIT[: len(MIT) // 2], "", "plain text",
    ]
    got = {r.id: r.license_id for r in license_scan.scan(table(texts)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 4: "ISC", 5: None, 6: None, 7: None, 8: None}


def test_any_wrapping_has_the_same_digest(table):
    """Breaks at any place, also inside spellings of two words, and a claim on the text's own line."""
    draw, bsd = random.Random(6), license_scan.TEXTS["BSD-3-Clause"][0].replace("copyright holder", "copyright owner").replace("COPYRIGHT HOLDER", "COPYRIGHT OWNER")
    mit = MIT.replace("NONINFRINGEMENT", "NON INFRINGEMENT").replace("sublicense", "sub-licence")
    wrapped = ["".join(draw.choice([" ", " ", "\n", "\r\n", "\n  * "]) if c.isspace() else c for c in draw.choice([mit, bsd])) for _ in range(40)]
    texts = [*wrapped, bsd.replace(" ", "\n"), mit.replace(" ", "\n"), *(claim + MIT for claim in ("Copyright (c) 2020 A B. ", "Copyright 1999-2020 Foo Inc. All rights reserved. ", "(c) J. R. Doe. "))]
    got = {r.id: (r.license_id, r.digest) for r in license_scan.scan(table(texts)).collect()}
    assert len({d for name, d in got.values() if name == "MIT"}) == len({d for name, d in got.values() if name == "BSD-3-Clause"}) == 1
    assert {name for name, _ in got.values()} == {"MIT", "BSD-3-Clause"}


def test_spellings_begin_at_words(table):
    got = {r.id: r.digest for r in license_scan.scan(table(["some silicence text", "some silicense text", "a licence", "a license"])).collect()}
    assert got[0] != got[1] and got[2] == got[3]


def test_every_known_text_is_found(table):
    own = [(name, text) for name, texts in license_scan.TEXTS.items() for text in texts]
    got = {r.id: r.license_id for r in license_scan.scan(table([t for _, t in own])).collect()}
    assert got == {k: name for k, (name, _) in enumerate(own)}


def test_notices_are_whole_lines(table):
    texts = ["x\nReleased under the MIT Licence!\ny", "It was released under the MIT License yesterday", "a\nspdx-license-identifier: gpl-3.0-only\nAll rights reserved."]
    got = {r.id: r.notices for r in license_scan.scan(table(texts)).collect()}
    assert got == {0: ["MIT"], 1: [], 2: ["GPL-3.0", "all-rights-reserved"]}


def test_claims_above_a_text_do_not_hide_it(table):
    bsd, wrapped = license_scan.TEXTS["BSD-3-Clause"][0], MIT.replace("AUTHORS OR COPYRIGHT", "AUTHORS OR\nCOPYRIGHT").replace("above copyright", "above\ncopyright")
    assert wrapped.count("\n") > MIT.count("\n") + 1
    texts = [
        "Copyright Jane Doe\n\n" + MIT, "Copyright The X Authors\n" + MIT, "MIT License\n\nCopyright Jane Doe 2020\n\n" + wrapped, "Copyright (c) 1990, A B\nAll rights reserved.\n\n" + bsd,
        "Copyright (c) 1990\n  The Regents of X.  All rights reserved.\n\n" + bsd, "Copyright And Sons\n" + MIT, "Copyright Jane Doe\n" + MIT + "\nand more", "Copyright Jane Doe\nAll rights reserved.",
    ]
    got = {r.id: r.license_id for r in license_scan.scan(table(texts)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 4: "BSD-3-Clause", 5: "MIT", 6: None, 7: None}


def test_full_texts_are_known(spark, table):
    own = license_scan.known_texts(spark).collect()
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= {r.license_id for r in own}
    got = {r.id: r.license_id for r in license_scan.scan(table([r.text.upper().replace("\n", "\r\n") for r in own])).collect()}
    assert got == {k: r.license_id for k, r in enumerate(own)}


def test_a_table_of_texts_adds_to_the_known_ones(spark, table):
    more = spark.createDataFrame([("Mine", "Copyright Me\nDo what you like with it."), ("Mine-2", "do what you like with IT"), ("Void", "Copyright Me"), ("None", None), (None, "x y")], "license_id string, text string")
    texts = ["Do what you like with it!", "Copyright (c) 2020 You\ndo what you like\nwith it", "x y", "", "Copyright Me", MIT, "Copyright Jane\nall rights reserved\nDo what you like with it."]
    got = [(r.id, r.license_id) for r in license_scan.scan(table(texts), texts=more).orderBy("id").collect()]
    assert got == [(0, "Mine-2"), (1, "Mine-2"), (2, None), (3, None), (4, "Void"), (5, "MIT"), (6, "Mine-2")]


def test_awkward(awkward, empty):
    got = license_scan.scan(awkward).collect()
    assert len(got) == awkward.count() and all(r.license_id is None and r.notices == [] for r in got)
    assert license_scan.scan(empty).count() == 0
