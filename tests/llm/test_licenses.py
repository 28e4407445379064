import sys
from pathlib import Path

import pytest
from helpers import SF, awkward, empty

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from compare import connect, difference

from probanda.llm import licenses
from probanda.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    assert difference(QUERIES["op3_licenses"](spark, folder), connect(folder), SQL["op3_licenses"]) is None


def test_every_known_sentence_passes_the_hint():
    import re

    assert [s for s in licenses.KNOWN if not re.search(licenses.HINT, s)] == []


def test_ordered_rules(spark):
    grant = licenses.SENTENCES["mit-grant"][0]
    texts = [
        (1, f"The MIT License\n{grant}.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
        (2, "Words before. Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. More."),
        (3, "Licensed under CC BY-NC 4.0\r\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."),
        (4, "You may not use this file except in compliance with the License."),
        (5, "My text is licensed under terms I made up."),
    ]
    got = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.report(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", ""), 2: ("CC-BY-NC-4.0,Apache-2.0", ""), 3: ("CC-BY-NC-4.0,MIT", ""), 4: ("", "apache2-comply"), 5: ("", "")}


APACHE = """#   Licensed under the Apache License, Version 2.0 (the "License");
#   you may not use this file except in compliance with the License.
#   You may obtain a copy of the License at
#
#       http://www.apache.org/licenses/LICENSE-2.0
#
#   Unless required by applicable law or agreed to in writing, software
#   distributed under the License is distributed on an "AS IS" BASIS,
#   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"""
GPL = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 */"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


NAMES = """3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_wrapped_notices_and_spdx_lines(spark):
    want = [
        (APACHE, "Apache-2.0"), (MIT, "MIT"), (GPL.format(3), "GPL-3.0-or-later"), (GPL.format(2), "GPL-2.0-or-later"), (BSD, "BSD-2-Clause"),
        ("x = 1\n# SPDX-License-Identifier: MIT\n", "MIT"), ("/* SPDX-License-Identifier: GPL-2.0+ */", "GPL-2.0-or-later"), ("f(); // SPDX-License-Identifier: MPL-2.0\ng();", "MPL-2.0"),
        ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-or-later\n", "MIT,Apache-2.0,GPL-3.0-or-later"), ("// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"),
        *((BSD + "\n" + NAMES.format(who), "BSD-3-Clause") for who in ("the copyright holder", "Acme Inc.", "the\n * University of X, Y & Co.", "the author")),
        (BSD + "3. The name of the author may not be used to endorse or promote products\nderived from this software without specific prior written permission.", "BSD-3-Clause"),
        ("we spoke of the MIT license\nand of others", ""),
    ]
    got = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.report(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")).collect()}
    assert got == {i: (w, "") for i, (_, w) in enumerate(want)}


def test_no_identifier_ends_another():
    names = set(licenses.EVERY.values())
    assert [(a, b) for a in names for b in names if a != b and a.endswith(b)] == []
    assert {n for _, wanted in licenses.MORE_RULES for n in wanted if not n.startswith("spdx-")} <= names


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = licenses.find(docs)
    assert set(docs.columns) <= set(rows.columns)
    assert len(rows.collect()) == 10
    assert licenses.report(empty(spark)).collect() == []
