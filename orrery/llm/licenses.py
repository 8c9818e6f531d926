"""Licence scans by canonical digest.

A text is brought to a canonical form (copyright lines left out, letters in
lower case, anything that is no letter or digit one space, equivalent
spellings the same) and its digest joined with the digests of known licences.
Whole texts are looked up by a hash join with the fixed table of known
digests. Lines that equal a known one-line notice are told besides.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.columns import numbered, place

#: Spellings that count as the same, in canonical form (fixed values, after public licence matching guidelines).
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("modelled", "modeled"),
    ("non commercial", "noncommercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("organised", "organized"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "wilfull"),
)
#: A line that names a holder or a year, or reserves rights, and no more; "copyright holders be liable" in wrapped text is none.
_COPYRIGHT = r"(?i:copyright[ \t]*(?:\(c\)|©|[0-9<\[{]|by[ \t])|\(c\)[ \t]*(?:copyright|[0-9<\[{])|©|all rights reserved[.]?[ \t\r]*$)"
_LETTERS = r"a-z0-9\x{80}-\x{10FFFF}"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_REST = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: (licence, text) of known licences and notices (fixed values).
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC_GRANT + _ISC_NOTICE + _ISC_REST),
    ("ISC", "ISC License\n" + _ISC_GRANT + _ISC_NOTICE + _ISC_REST),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", _ISC_GRANT + "." + _ISC_REST),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_REST),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_REST),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_REST),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_REST),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)


#: (digest, licence) of whole texts too long to state here, as their publishers give them (fixed values).
DIGESTS = (
    ("12a85b332018df39119ce5b54ff3254876bf25b6a421cfb9e677f8eb39746141", "Apache-2.0"),
    ("f99846a93fd33d4207ae37f184d79f876d26cfacdeb5241d15b6a4550202d569", "GPL-1.0"),
    ("67cd2c0e514c5ae45fbd9c8e22892d5f4f23beef7566f266dfe6985d9ad8b44a", "GPL-2.0"),
    ("c373b7e932b2424068fd5f97be61eb01e3d9c9b8f84f7e7ab41873cae07968be", "GPL-3.0"),
    ("4d2c9d3bb636ba85c5c171e3f3bc4b005910c7e79114ee894f8cd0af61a70956", "LGPL-2.0"),
    ("8b93158efbb9b164a0ae9297cd3537b8156fbfbe203547daf1c377e107bd1369", "LGPL-2.1"),
    ("91b5d3e9e307d305f7c91670699dcefa38a95bc0127f171027869fadcae9f986", "LGPL-3.0"),
    ("0cddcbac38fe198379bc6b622f6f0bbbbad0db8e25a48f526156318e9144dfc3", "MPL-1.1"),
    ("a8e65d84dc49905541b3c0308843a26aec2d19c0792b46ac3443015259bccdcd", "MPL-2.0"),
    ("42e5c3e2dc951231f2f015709c4dce5e7c7b5cec0527b379b23e49bfafea1472", "CC0-1.0"),
    ("4a9e598f2d3546e0aa508a67933a0a8fa28404de6ba40ee237bd43df3d35a18d", "GFDL-1.2"),
    ("57a99d94fc082967d8b8d18cbf4eff102162c14249ddaf1c1d62756bd87ef919", "GFDL-1.3"),
    ("aaeead919194d7776b3b35b713d94843f81c54ba8da59df70d9f759c0ec8a85d", "Artistic-1.0-Perl"),
)


def canonical(text: str) -> str:
    """The canonical form of a text: its words one space apart, each spelling replaced where it stands as words of its own."""
    text = "".join(line for line in re.split(r"(?<=\n)", text) if not re.match(r"[ \t\r]*" + _COPYRIGHT, line))
    text = re.sub(r"[^a-z0-9\u0080-\U0010FFFF]+", " ", text.lower().replace("'", ""))
    # two spaces between words, so that neighbours do not share one
    text = f" {text.strip(' ').replace(' ', '  ')} "
    for a, b in EQUIVALENT:
        text = text.replace(f" {a.replace(' ', '  ')} ", f" {b.replace(' ', '  ')} ")
    return text.replace("  ", " ").strip(" ")


def canonical_column(text: Column) -> Column:
    """The same of a column, all JVM-side; a line ends at a line feed and nowhere else."""
    text = F.regexp_replace(text, r"(?md)^[ \t\r]*" + _COPYRIGHT + r"[^\n]*", "")
    text = F.replace(F.lower(text), F.lit("'"), F.lit(""))
    text = F.replace(F.trim(F.regexp_replace(text, f"[^{_LETTERS}]+", " ")), F.lit(" "), F.lit("  "))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for a, b in EQUIVALENT:
        text = F.replace(text, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.replace(text, F.lit("  "), F.lit(" ")))


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def known_digests(known: tuple = KNOWN) -> dict[str, str]:
    """Licences by digest: of the known texts and, beside them, of whole texts that are known by digest alone."""
    return {digest(text): name for name, text in known} | (dict(DIGESTS) if known is KNOWN else {})


def _first_words(known: tuple) -> str:
    """A pattern of a line's beginning that every line equal to a known one-line notice has."""
    words = {canonical(text).split(" ")[0] for _, text in known if "\n" not in text}
    words |= {a.split(" ")[0] for a, b in EQUIVALENT if b.split(" ")[0] in words}
    return f"^[^{_LETTERS}]*(?:{'|'.join(sorted(words))})(?![{_LETTERS}])"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: tuple = KNOWN) -> DataFrame:
    """A row for each row of docs: doc_id, canonical_digest, license (of the whole text, or null), notices (licences of its lines, sorted, joined by a comma; or empty).

    The licence is found by a hash join of the whole text's digest. Notices
    are an extra: lines that equal a known one-line notice in canonical form.
    Null texts count as empty, which is no licence. Each text and line is
    looked up whole, whatever its length. Repeated rows are scanned alike;
    further columns, of whatever names, are not looked at; an empty table
    gives an empty result. No row is shuffled.
    """
    digests = known_digests(known)
    table = docs.sparkSession.createDataFrame(list(digests.items()), "known_digest string, known_license string")
    rows = numbered(docs).select(F.col(place(docs, id_col)).alias("doc_id"), F.coalesce(F.col(place(docs, text_col)), F.lit("")).alias("text"))
    starts = F.lit(_first_words(known))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(F.replace(F.lower(x), F.lit("'"), F.lit("")), starts))
    names = F.create_map(*[F.lit(x) for pair in digests.items() for x in pair])
    found = F.transform(lines, lambda x: F.element_at(names, F.sha2(canonical_column(x), 256)))
    notices = F.array_join(F.array_sort(F.array_distinct(F.array_compact(found))), ",")
    scanned = rows.select("doc_id", F.sha2(canonical_column(F.col("text")), 256).alias("canonical_digest"), notices.alias("notices"))
    # as many rows as KNOWN and DIGESTS
    joined = scanned.join(F.broadcast(table), F.col("canonical_digest") == F.col("known_digest"), "left")
    return joined.select("doc_id", "canonical_digest", F.col("known_license").alias("license"), "notices")


def oracle_sql(known: tuple = KNOWN) -> str:
    """The same in DuckDB's SQL."""
    said = _COPYRIGHT.replace("'", "''")

    def form(x: str) -> str:
        x = rf"regexp_replace({x}, '(?m)^[ \t\r]*{said}[^\n]*', '', 'g')"
        x = f"replace(lower({x}), '''', '')"
        x = rf"' ' || replace(trim(regexp_replace({x}, '[^{_LETTERS}]+', ' ', 'g'), ' '), ' ', '  ') || ' '"
        for a, b in EQUIVALENT:
            x = f"replace({x}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
        return f"trim(replace({x}, '  ', ' '), ' ')"

    values = ", ".join(f"('{d}', '{name}')" for d, name in known_digests(known).items())
    return f"""
WITH known(d, name) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs),
notices AS (
  SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS notices
  FROM lines JOIN known ON sha256({form("line")}) = d WHERE line <> '' GROUP BY r)
SELECT doc_id, sha256({form("t")}) AS canonical_digest, k.name AS license, coalesce(notices, '') AS notices
FROM docs LEFT JOIN known k ON sha256({form("t")}) = k.d LEFT JOIN notices USING (r)
"""
