"""Every known sentence and rule as wrapped notices write them."""

import textwrap

import pytest

from loglode.llm import license_scan

from .test_operators import frame

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT ..."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.

{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT ..."""
NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for more."""
GPL = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
NOTICES = [("MIT", MIT), ("BSD-3-Clause", BSD.format(NAMES)), ("BSD-2-Clause", BSD.format("")), ("Apache-2.0", APACHE), ("GPL-3.0-or-later", GPL.format(":")), ("GPL-3.0-or-later", GPL.format(";")), ("MPL-2.0", MPL)]
NOTICES += [(n, f"SPDX-License-Identifier: {x}") for n, x in (("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-3.0-or-later", "GPL-3.0-or-later"), ("BSD-3-Clause", "BSD-3-Clause"))]


def wrapped(text, width, lead, end="\n"):
    lines = [x for part in text.split("\n\n") for x in [*textwrap.wrap(part, width, break_long_words=False, break_on_hyphens=False), ""]]
    return end.join(lead + x for x in ["Copyright 2020 A Person", "", *lines])


@pytest.mark.parametrize("width,lead,end", [(30, "", "\n"), (70, " * ", "\n"), (70, "# ", "\r\n"), (9999, "// ", "\n")])
def test_notices(spark, width, lead, end):
    rows = [(k, wrapped(text, width, lead, end)) for k, (_, text) in enumerate(NOTICES)]
    got = {x.doc_id: (x.licenses, x.unknown_ids) for x in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert got == {k: (name, "") for k, (name, _) in enumerate(NOTICES)}


@pytest.mark.parametrize("width", [12, 40, 9999])
def test_every_sentence_and_rule(spark, width):
    all_known = license_scan.SENTENCES + license_scan.LONGER
    known = dict(license_scan.SENTENCES)
    rows = [(k, f"Some words.\n{textwrap.fill(s, width, break_long_words=False)}.\nMore words.") for k, (_, s) in enumerate(all_known)]
    rows += [(1000 + k, ".\n\n".join(textwrap.fill(known[i], width, break_long_words=False) for i in ids)) for k, (_, ids) in enumerate(license_scan.RULES)]
    got = {x.doc_id: x for x in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert [got[k].sentence_ids for k in range(len(all_known))] == [name for name, _ in all_known]
    assert [(got[1000 + k].licenses, got[1000 + k].unknown_ids) for k in range(len(license_scan.RULES))] == [(name, "") for name, _ in license_scan.RULES]
