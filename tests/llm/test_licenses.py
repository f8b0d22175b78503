import duckdb
import pytest

from pyspark.sql import functions as F

from chiffra.llm import licenses

MIT = "Released under the MIT License."
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\nother"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
BSD2 = BSD + "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
BSD3 = BSD2 + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
CASES = [(MIT, ["MIT"], ""), (f"words {MIT}", [], ""), (f"Words. {MIT} More\n{MIT}", ["MIT"], ""), (APACHE, ["Apache-2.0"], ""), (BSD, [], "bsd-grant bsd-source"), (BSD2, ["BSD-2-Clause"], ""), (BSD3 + "\n" + BSD2, ["BSD-3-Clause", "BSD-2-Clause"], ""), ("All rights reserved", ["LicenseRef-AllRightsReserved"], ""), (None, [], ""), ("", [], ""), ("licens permission", [], ""), ("x" * 200_000 + "\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"], "")]


def test_rules(spark):
    df = spark.createDataFrame([(i, t, "z") for i, (t, _, _) in enumerate(CASES)] + [(None, MIT, None)] * 2, "doc_id long, text string, licenses string")
    out = licenses.scan(df).collect()
    assert len(out) == len(CASES) + 2
    for r in out:
        i = r["row"]["doc_id"]
        want = CASES[i] if i is not None else CASES[0]
        assert (r["licenses"], r["unmatched"]) == (want[1], want[2]), i
    assert licenses.scan(df.limit(0)).count() == 0


MIT_TEXT = """MIT License

Copyright (c) 2020 A. N. Author

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE_TEXT = """# Copyright 2020 A. N. Author
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os
"""
GPL_TEXT = """/*
 * A program that counts.
 *
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
"""
MPL_TEXT = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n"
ISC_TEXT = "Title of the thing\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."


@pytest.mark.parametrize("text, licence", [(MIT_TEXT, "MIT"), (APACHE_TEXT, "Apache-2.0"), (GPL_TEXT, "GPL-2.0-or-later"), (MPL_TEXT, "MPL-2.0"), (ISC_TEXT, "ISC")])
def test_wrapped_texts(spark, text, licence):
    flat = " ".join(text.replace("#", " ").replace("*", " ").split())
    forms = [text, text.replace("\n", "\r\n"), "Words before it.\n\n" + text + "\n\nand after it."]
    if licence not in ("Apache-2.0", "ISC", "MIT"):
        forms.append(flat)
    out = licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(forms)], "doc_id long, text string")).collect()
    assert [(r["licenses"], r["unmatched"]) for r in out] == [([licence], "")] * len(forms)


def test_far_apart_is_not_successive(spark):
    first, *rest = [x for x in MIT_TEXT.split("\n\n") if "hereby" in x or "above" in x]
    for n, want in ((licenses.GAP, ["MIT"]), (licenses.GAP + 1, [])):
        text = first + "\n\n" + "An unknown sentence. " * n + "\n\n" + rest[0]
        assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["licenses"] == want


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    for k, x in enumerate((MIT_TEXT, APACHE_TEXT, GPL_TEXT, MPL_TEXT, ISC_TEXT)):
        con.execute("create or replace table extra as select * from documents limit 0") if not k else None
        con.execute("insert into extra (doc_id, text) values (?, ?)", [k, x])
    con.execute("create or replace view documents as select doc_id, text from extra")
    df = spark.createDataFrame(con.execute("select doc_id, text from documents").fetchall(), "doc_id long, text string")
    ids = F.array_join(F.transform("sentences", lambda x: F.concat(x["sentence"].cast("string"), F.lit(":"), x["id"])), " ")
    mine = licenses.scan(df).select("row.doc_id", F.size("sentences").cast("long"), ids, F.array_join("licenses", ", "), "unmatched")
    assert sorted(tuple(r) for r in mine.collect()) == sorted(con.execute(licenses.SQL["op3_license_scan"]).fetchall())
    con.execute(f"create or replace view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = con.execute(licenses.SQL["op3_license_scan"]).fetchall()
    got = [tuple(r) for r in licenses.op3_license_scan(spark, sf).collect()]
    assert sorted(got) == sorted(want) and any(r[3] for r in got)


BSD3_TEXT = BSD3.replace("copyright holder nor", "Acme Corp. of New York, Inc. nor") + "\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"


@pytest.mark.parametrize("text, licences", [
    (BSD3_TEXT, ["BSD-3-Clause"]), (BSD3_TEXT.replace("\n", " "), ["BSD-3-Clause"]), (" ".join(MIT_TEXT.split()), ["MIT"]), ("SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
    ("// SPDX-License-Identifier: (MIT OR GPL-2.0-or-later)\nint x;", ["MIT", "GPL-2.0-or-later"]), ("# SPDX-License-Identifier: GPL-3.0+\n", ["GPL-3.0-or-later"]), ("licensed under the terms of the MIT license", ["MIT"]),
    ("name: x\nLicense: GPLv3\nversion: 1", ["GPL-3.0-only"]), ("License: unknown", []), ("The license: see below. MIT is a school.", []), (" ".join(ISC_TEXT.split()), ["ISC"]),
])
def test_holders_tags_and_single_lines(spark, text, licences):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses.scan(df).first()["licenses"] == licences
    con = duckdb.connect()
    con.execute("create table documents as select 1::bigint doc_id, ?::varchar as text", [text])
    assert con.execute(licenses.SQL["op3_license_scan"]).fetchall()[0][3] == ", ".join(licences)
