"""Licence recognition on standard texts, wrapped as they are in the wild."""

from __future__ import annotations

import re

import pytest

from reelspark.llm.license_scan import HINT, LICENCES, SENTENCES, TOPIC, scan_licences

MIT = """Copyright (c) 2019 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""

ISC = """Copyright 2004 by Some People

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES."""

BSD = """Copyright (c) 2010, The Project
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""

GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""

MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def _commented(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.splitlines())


CASES = [
    (MIT, "MIT"), ("MIT License\n\n" + MIT, "MIT"), (_commented(MIT, " *"), "MIT"), (_commented(MIT, "//"), "MIT"), (MIT.replace("\n", "\r\n"), "MIT"),
    (" ".join(MIT.split()), "MIT"), (ISC, "ISC"), (_commented(ISC, "#"), "ISC"), (BSD, "BSD-2-Clause,all-rights-reserved"),
    (BSD3, "BSD-3-Clause,all-rights-reserved"), (_commented(BSD3, "#"), "BSD-3-Clause,all-rights-reserved"), (GPL3, "GPL-3.0-or-later"),
    (_commented(GPL3, "//"), "GPL-3.0-or-later"), (GPL3.replace("version 3", "version 2"), "GPL-2.0-or-later"),
    (GPL3.replace("GNU General", "GNU Affero General"), "AGPL-3.0-or-later"), (GPL3.replace("GNU General", "GNU Lesser General"), "LGPL-3.0-or-later"),
    (APACHE, "Apache-2.0"), (_commented(APACHE, "#"), "Apache-2.0"), (MPL, "MPL-2.0"), (_commented(MPL, "/*"), "MPL-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation", "GPL-3.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991", "GPL-2.0"),
    ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", "Apache-2.0"),
    ("Available under CC BY-SA 4.0.", "CC-BY-SA"), ("CC0", "CC0-1.0"), ("_CC0_", "CC0-1.0"), ("Creative Commons Attribution 4.0", "CC-BY"),
    ("Creative\nCommons\nAttribution-NonCommercial-ShareAlike", "CC-BY-NC-SA"), ("text\nSPDX-License-Identifier: MIT\nmore", "MIT"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"), ("SPDX-License-Identifier: Zlib", "SPDX-reference"),
    ("MIT License\nApache License 2.0", "Apache-2.0,MIT"), ("A fine day.\nNothing about it", ""), ("The permission was granted. He said so.", ""),
]


def test_standard_texts(spark, make_docs):
    got = {r.doc_id: r.licenses for r in scan_licences(make_docs([(i, t) for i, (t, _) in enumerate(CASES)])).collect()}
    assert [(t, got[i]) for i, (t, want) in enumerate(CASES) if got[i] != want] == []


def test_every_rule_passes_the_gate():
    """A sentence that a rule names is never gated out: each alternative of its pattern holds a hint."""
    for ident, pattern in SENTENCES:
        plain = pattern.replace(r"\b", "").replace(r"\.", ".").replace(" ?", "").lstrip("^")
        assert re.search(HINT.replace(r"\b", ""), plain.replace("(?:lesser|library)", "lesser").replace("(?:affero |lesser |library )?", "")), ident
    for hint in TOPIC.replace("[cs]", "c").split("|"):
        assert re.search(HINT, hint)
    known = {i for i, _ in SENTENCES}
    assert all(set(run) <= known for _, run in LICENCES)


@pytest.mark.parametrize("gap", ["", "\n", " \n\t\n"])
def test_long_and_repeated(spark, make_docs, gap):
    text = gap.join(["word " * 30_000, MIT, "and so on " * 1000])
    got = scan_licences(make_docs([(1, text), (1, text), (None, text)])).collect()
    assert [r.licenses for r in got] == ["MIT"] * 3
