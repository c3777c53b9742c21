"""Whole licence texts with made-up holders, and the licence files of this machine where it has them."""

import os
import textwrap

import pytest

from pulseloom.llm import license_scan

HEAD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
TWO = HEAD + textwrap.dedent("""\
    1. Redistributions of source code must retain the above copyright notice,
       this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright
       notice, this list of conditions and the following disclaimer in the
       documentation and/or other materials provided with the distribution.
    """)
END = textwrap.dedent("""
    THIS SOFTWARE IS PROVIDED BY {who} "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
    EVENT SHALL {who} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
    EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
    PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
    OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
    WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
    OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
    OF THE POSSIBILITY OF SUCH DAMAGE.
    """)
MAY = "may be used to endorse or promote products\n   derived from this software without specific prior written permission.\n"
THIRD = (
    "3. Neither the name of the Blue Heron Works nor the names of its contributors " + MAY,
    "3. Neither the name of Müller & Søn GmbH nor the names of its\n   contributors " + MAY,
    "   * Neither the name of Heron Inc. nor the names of its contributors " + MAY,
    "3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n",
    "3. The names of Ada Heron and others must not be used to endorse or promote\n   products derived from this software without prior written permission.\n",
)
PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"
AUTHOR = '\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS.\n'
MADE = [
    *[("BSD-3-Clause", f"Copyright (c) 2019, Heron.\nAll rights reserved.\n\n{TWO}{third}{END.format(who=who)}") for third in THIRD for who in ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE HERON WORKS", "ADA HERON ''AND OTHERS''")],
    ("BSD-2-Clause", f"Copyright 2020 Ada Heron\n\n{TWO}{END.format(who='ADA HERON')}"),
    ("", f"Copyright 2020 Ada Heron\n\n{TWO}3. All advertising materials mentioning this software need a licence of the author.\n{END.format(who='ADA HERON')}"),
    ("", f"{TWO}3. Redistributions of any form must name the Heron project.\n"),
    ("0BSD", f"Copyright 2021 Heron\n\n{PERMISSION}.{AUTHOR}"),
    ("ISC", f"Copyright 2021 Heron\n\n{PERMISSION}, provided that the above\ncopyright notice and this permission notice appear in all copies.{AUTHOR}"),
    ("Apache-2.0,MIT", "Heron may be distributed under either licence\n\n  * The Apache 2.0 License\n    http://www.apache.org/licenses/LICENSE-2.0\n\n  * The MIT License\n    http://opensource.org/licenses/MIT\n"),
    ("PSF-2.0", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2\n--------------------------------------------\n\n1. This LICENSE AGREEMENT is between us.\n"),
    ("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\n"),
    ("LGPL-3.0-only", "GNU LESSER GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nText.\n"),
    ("CC0-1.0", "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n3. Public License Fallback. Should any part\n"),
    ("Apache-2.0", 'Definitions.\n\n  "License" shall mean the terms and conditions for use, reproduction,\n  and distribution as defined by Sections 1 through 9 of this document.\n'),
]
FILES = {
    "Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2-only", "GFDL-1.3": "GFDL-1.3-only", "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-or-later", "GPL-3": "GPL-3.0-or-later",
    "LGPL-2": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-or-later", "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


@pytest.mark.parametrize("lead", ["", "# ", " * "])
def test_texts_with_made_up_holders(spark, lead):
    d = spark.createDataFrame([(k, "\n".join((lead + x).rstrip() for x in t.split("\n"))) for k, (_, t) in enumerate(MADE)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(d).collect()}
    assert [(MADE[k][0], got[k]) for k in got if got[k] != MADE[k][0]] == []


def test_files_of_this_machine(spark):
    place = "/usr/share/common-licenses"
    found = {n: open(f"{place}/{n}", errors="replace").read() for n in FILES if os.path.exists(f"{place}/{n}")}
    if not found:
        pytest.skip("no licence files here")
    got = {r["n"]: r["licenses"] for r in license_scan.scan(spark.createDataFrame(list(found.items()), "n string, t string"), "n", "t").collect()}
    assert got == {n: FILES[n] for n in found}


def test_slots_are_of_bounded_length(spark):
    long = "Neither the name of " + "very " * 60 + "long nor the names of its contributors " + MAY
    (row,) = license_scan.scan(spark.createDataFrame([(1, TWO + "3. " + long)], "doc_id long, text string")).collect()
    assert row["licenses"] == "" and "bsd_names" not in row["sentence_ids"]
