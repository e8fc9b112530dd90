from pathlib import Path

import pytest

from tuffstone.llm import licensing as lic
from tuffstone.llm.license_texts import TEXTS

SPELLINGS = {
    "GPL v2 or later": "GPL-2.0-or-later", "GPL-2": "GPL-2.0-only", "LGPLv2.1+": "LGPL-2.1-or-later", "Apache-2.0 / MIT": "Apache-2.0 OR MIT", "(MIT OR Apache-2.0)": "Apache-2.0 OR MIT", "The MIT License": "MIT",
    "GNU Affero General Public License, version 3 or any later version": "AGPL-3.0-or-later", "LicenseRef-Some-EULA": "LicenseRef-Some-EULA", "3-clause BSD license": "BSD-3-Clause", "CC0 1.0 Universal": "CC0-1.0",
    "Boost Software License 1.0": "BSL-1.0", "something else": "something else", " ": None,
}


def test_spellings():
    assert {k: lic.read_license(k) for k in SPELLINGS} == SPELLINGS
    assert lic.read_license(None) is None


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("/*\n * Released by its makers under the terms of the GNU General\n * Public License, version 2 or any later version.\n */", {"GPL-2.0-or-later"}),
        ("# You may use this file under either the MIT License or the\n# Apache License, Version 2.0, as you choose.\n", {"Apache-2.0 OR MIT"}),
        ("// released with its makers under the terms of the ISC License.\n", {"ISC"}),
        ("// SPDX-License-Identifier:mit\n// or GPL-2.0", {"MIT"}),
        ('MODULE_LICENSE("GPL v2");', {"GPL-2.0-only"}),
        ("/* TODO ask whether GNU General Public License, version 2 code may be pulled in here */", set()),
        ("/* links against libx, whose authors chose the MIT License */", set()),
        ("# recognises the SPDX-License-Identifier tag in other files", set()),
        ("the MIT License applies to everything in this work.", {"MIT"}),
        ("* Licence: MIT\n* The makers chose The Unlicense for this file.", {"MIT", "Unlicense"}),
        ("", set()),
        (None, set()),
    ],
)
def test_statements(text, said):
    assert {s[1] for s in lic.content_statements(text, False, lic.Templates())} == said


def said(text, own=False):
    return {s[1] for s in lic.content_statements(text, own, lic.Templates())}


def test_expressions():
    want = {
        "MIT AND Apache-2.0": "Apache-2.0 AND MIT", "GPL-2.0 WITH Classpath-exception-2.0": "GPL-2.0-only WITH Classpath-exception-2.0", "(MIT OR Apache-2.0) AND ISC": "(Apache-2.0 OR MIT) AND ISC",
        "GPL-2.0-or-later WITH Linux-syscall-note": "GPL-2.0-or-later WITH Linux-syscall-note", "MIT OR ISC AND Zlib": "ISC AND Zlib OR MIT", "BSD-4-Clause": "BSD-4-Clause", "0BSD": "0BSD", "Artistic-2.0": "Artistic-2.0",
        "CC-BY-4.0": "CC-BY-4.0", "WTFPL": "WTFPL", "lgpl-2.1+": "LGPL-2.1-or-later", "LicenseRef-Some-EULA AND MIT": "LicenseRef-Some-EULA AND MIT",
    }
    for text, spdx in want.items():
        assert said(f"// SPDX-License-Identifier: {text}\n") == {spdx}, text
        assert lic.read_license(text) == spdx
    assert lic.expression("Foo-Bar-1.0") == "Foo-Bar-1.0" and lic.expression("see below") is None and lic.expression("MIT OR") is None and lic.expression("(MIT") is None


@pytest.mark.parametrize(("spdx", "text"), TEXTS)
def test_public_texts(spdx, text):
    assert said(f"Copyright (c) 2020 A. Nyone\n\n{text}\n", True) == {spdx}
    wrapped = "\n * ".join(text.split("\n"))
    assert said(f"/*\n * {wrapped}\n */\nint x;\n") == {spdx}


@pytest.mark.parametrize("later", [True, False])
@pytest.mark.parametrize(("name", "number", "spdx"), [("General", "2", "GPL-2.0"), ("General", "3", "GPL-3.0"), ("Lesser General", "2.1", "LGPL-2.1"), ("Affero General", "3", "AGPL-3.0")])
def test_gnu_headers(name, number, spdx, later):
    version = f"either version {number} of the\n# License, or (at your option) any later version." if later else f"version {number} of\n# the License."
    text = f"# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU {name} Public License as published by\n# the Free Software Foundation; {version}\n#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY. See the GNU {name} Public License for more details.\n"
    assert said(text) == {f"{spdx}-{'or-later' if later else 'only'}"}


def test_altered_clauses_of_texts_are_reported():
    text = dict(TEXTS)["MIT"].replace("without restriction, ", "").replace("sublicense, and/or sell", "sublicense")
    (got,) = lic.content_statements(text, False, lic.Templates())
    assert got[:2] == ("text of MIT", "MIT") and 0.9 < got[2] < 1 and got[3] == "clause 1: without restriction and / or sell"


@pytest.mark.parametrize("name", ["Apache-2.0", "CC0-1.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0"])
def test_long_texts_of_the_machine(name):
    path = Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("no license texts here")
    number = name.split("-")[1]
    want = name if number.endswith(".0") and "GPL" not in name else f"{name.split('-')[0]}-{number if '.' in number else number + '.0'}-only"
    assert said(path.read_text(), True) == {want}


def test_altered_words_are_reported():
    (got,) = lic.content_statements("released with its makers under the terms of the ISC License.", False, lic.Templates())
    assert got[2] < 1 and got[3] == "by"


def test_files_and_repositories(spark):
    files = [
        (1, 1, "LICENSE", "MIT License\n\nCopyright", None, 0), (2, 1, "src/a.c", "int x;", [], 0), (3, 1, "src/b.c", "// SPDX-License-Identifier: ISC", ["ISC", "isc"], 0),
        (4, 1, "lib/COPYING.txt", "# Zlib\n", None, 0), (5, 1, "lib/deep/c.c", None, None, 0), (6, 1, "lib/d.c", "", ["MIT", "ISC"], 0), (7, 2, "e.c", "x", None, 0), (8, None, "f.c", "x", None, 0),
        (9, 3, "licence", "Copyright y", None, 0), (10, 3, "g.c", "x", None, 0), (11, 1, "libx/h.c", "x", None, 0), (12, 2, None, None, None, 0),
    ]
    files += [(1000 + i, 1, f"src/h{i}.c", "x", None, 0) for i in range(200)]
    sf = spark.createDataFrame(files, "file_id bigint, repo_id bigint, path string, content string, licenses array<string>, dir int")
    findings = spark.createDataFrame([(7, "license", "GPL-3+", 80), (7, "license", "MIT", 0), (7, "secret", "x", 90), (999, "license", "MIT", 80), (2, "license", None, 80)], "file_id bigint, category string, type string, confidence int")
    components = spark.createDataFrame([(1, "mit"), (2, "Apache 2.0"), (2, "ASL 2.0"), (3, None), (3, ""), (None, "ISC"), (77, "MIT")], "repo_id bigint, license string")
    got = {(r.scope, r.subject_id): r.license for r in lic.licenses(sf, findings, components).collect()}
    want = {("file", 2): "MIT", ("file", 3): "ISC", ("file", 5): "Zlib", ("file", 6): "CONFLICT", ("file", 7): "GPL-3.0-or-later", ("file", 8): "UNKNOWN", ("file", 10): "UNKNOWN", ("file", 11): "MIT", ("file", 12): "UNKNOWN"}
    want |= {("file", 1000 + i): "MIT" for i in range(200)} | {("repo", 1): "MIT", ("repo", 2): "Apache-2.0", ("repo", 3): "UNKNOWN"}
    assert got == want
    assert lic.licenses(sf.limit(0), findings.limit(0), components.limit(0)).count() == 0
