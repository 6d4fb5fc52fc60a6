"""License scans of whole headers as they stand in files, and the SQL over the same rows."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixframe.llm import license_scan, license_sql

BSD = """/*
 * Copyright (c) 2019, Some Body
 * All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice,
 *    this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright
 *    notice, this list of conditions and the following disclaimer in the
 *    documentation and/or other materials provided with the distribution.
%s *
 * THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
 * AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, ARE DISCLAIMED.
 */
int main;"""
ENDORSE = """ * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.
"""
GPL = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU %sGeneral Public License as published by
# the Free Software Foundation; either version %s of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU %sGeneral Public License for more details."""
#: Name, text, licences.
CASES = [
    ("bsd2", BSD % "", "BSD-2-Clause"),
    ("bsd3", BSD % ENDORSE, "BSD-3-Clause"),
    ("gpl2", GPL % ("", "2", ""), "GPL-2.0-or-later"),
    ("gpl3", GPL % ("", "3", ""), "GPL-3.0-or-later"),
    ("lgpl", GPL % ("Lesser ", "2.1", "Lesser "), "LGPL-2.1-or-later"),
    ("agpl", GPL % ("Affero ", "3", "Affero "), "AGPL-3.0-or-later"),
    ("kernel", 'redistribute it under the GNU General Public License\nversion 2 as published by the Free Software Foundation.', 'GPL-2.0-only'),
    ("mit", 'MIT License\n\nCopyright (c) 2020 X\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software.\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or portions.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS.', 'MIT'),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS-IS" BASIS.', 'Apache-2.0'),
    ("mpl", 'This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.', 'MPL-2.0'),
    ("isc", 'Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.', 'ISC'),
    ("0bsd", 'Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.', '0BSD'),
    ("spdx", '// SPDX-License-Identifier: ISC\n#include <x>', 'ISC'),
    ("spdx2", '/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT */\n', 'GPL-2.0-only,MIT'),
    ("neg", 'This file is not licensed under the MIT License.', ''),
    ("neg2", 'It is no longer licensed under the GPL v2 but under the Apache License,\nversion 2.0.', 'Apache-2.0'),
    ("short", 'Licensed under GPLv2+ or LGPL-3.0. Also EPL 2.0', 'LGPL-3.0-only,GPL-2.0-or-later,EPL-2.0'),
    ("cc", 'Licensed under CC BY-NC 4.0.', 'CC-BY-NC-4.0'),
    ("cc2", 'Creative Commons Attribution-ShareAlike 3.0', 'CC-BY-SA-3.0'),
    ("cc0", 'Dedicated under CC0.', 'CC0-1.0'),
    ("rights", 'Copyright 2001 X.\nAll rights reserved.', 'Proprietary'),
    ("ref", 'Released under the MIT License.', 'MIT'),
    ("gpl", 'words\nunder the GNU GPL.\nmore', 'GPL'),
    ("none", 'A permission slip and a public notice of copyright', ''),
    ("null", None, ''),
    ("empty", '', ''),
    ("new", 'Under the new BSD license', 'BSD-3-Clause'),
    ("unl", 'This is free and unencumbered software released into the public domain.', 'Unlicense'),
    ("boost", 'Distributed under the Boost Software License, Version 1.0.', 'BSL-1.0'),
    ("gplapache", 'GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991', 'GPL-2.0-only'),
    ("windows", (BSD % ENDORSE).replace("\n", "\r\n"), "BSD-3-Clause"),
    ("two", "Under the MIT license. " + "word " * 200_000 + "\n\nDistributed under the GNU LGPL v2.1 or later.", "LGPL-2.1-or-later,MIT"),
    ("again", "Released under the MIT License. Released under the MIT License.", "MIT"),
    ("two versions", "under the GNU General Public License version 2 or the GNU GPL version 3", "GPL-2.0-only,GPL-3.0-only"),
    ("short names", "Released under Apache 2.0. BSD-3-Clause. WTFPL", "Apache-2.0,BSD-3-Clause,WTFPL"),
    ("words", "The license of the bus driver, a copyright notice and gplot.", ""),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(n, t, "x", 1) for n, t, _ in CASES], "doc_id string, text string, ids string, r0 int")
    return {r["doc_id"]: tuple(r) for r in license_scan.scan(docs).collect()}


def test_headers_give_their_licences(found):
    assert {n: found[n][2] for n, _, _ in CASES} == {n: want for n, _, want in CASES}
    assert all(r[3] == len([x for x in r[2].split(",") if x]) for r in found.values())


def test_sql_gives_the_same_rows(found):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(n, t) for n, t, _ in CASES], columns=["doc_id", "text"]))
    assert {r[0]: r for r in con.sql(license_sql.SCAN).fetchall()} == found


def test_every_known_sentence_passes_the_hints(spark):
    said = [(t,) for _, t, want in CASES if want]
    assert spark.createDataFrame(said, "text string").where(~F.lower("text").rlike(license_scan.HINTS)).count() == 0


def test_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "Under the ISC license."), (1, "Under the ISC license."), (None, "CC0")], "doc_id long, text string")
    assert sorted(r["licenses"] for r in license_scan.scan(docs).collect()) == ["CC0-1.0", "ISC", "ISC"]
    assert license_scan.scan(docs.limit(0)).count() == 0
