"""Licence texts found by canonical digest.

A text is brought to a canonical form: A-Z lower-cased, copyright lines dropped, every run of other
characters than letters and digits made one space, equivalent spellings made one. Its SHA-256 is
joined with the digests of known licence texts, so only entire texts match. A text without a match
is tried once more as a licence file: copyright lines may stand behind comment marks or lack a year.

Rows: null is the empty text; a text that is no known licence has a null ``license_id``; repeated
rows give repeated results; an empty table gives none; a very long text is digested whole like any other.
Extra columns are not read.
"""

from __future__ import annotations

import pkgutil
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_groups, materialise

# Public licence texts without their copyright lines.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

_CLAUSES = TEXTS["BSD-2-Clause"].split("\n")
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

# Further texts without a title; several may share an id.
BODIES = [
    *TEXTS.items(),
    ("ISC", TEXTS["ISC"].replace("and/or", "and")),
    ("BSD-3-Clause", "\n".join([*_CLAUSES[:3], _THIRD, _CLAUSES[3]])),
]

# Titles that published files of these licences begin with.
TITLES = {
    "MIT": ["MIT", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"],
    "ISC": ["ISC", "ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "0BSD": ["0BSD", "BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "Free Public License 1.0.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License", 'BSD 3-Clause "New" or "Revised" License'],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
}

# Id and file of the licences that are published as one whole text.
FILES = {
    "Apache-2.0": "Apache-2.0",
    "CC0-1.0": "CC0-1.0",
    "GPL-1.0": "GPL-1",
    "GPL-2.0": "GPL-2",
    "GPL-3.0": "GPL-3",
    "LGPL-2.0": "LGPL-2",
    "LGPL-2.1": "LGPL-2.1",
    "LGPL-3.0": "LGPL-3",
    "MPL-1.1": "MPL-1.1",
    "MPL-2.0": "MPL-2.0",
}
#: What may be left out behind a text, from these words on.
APPENDIX = {"Apache-2.0": "APPENDIX: How to apply"}

# Spellings that count as one, among words that single spaces part.
SPELLINGS = {
    "licence": "license",
    "sub license": "sublicense",
    "non infringement": "noninfringement",
    "copyright owner": "copyright holder",
    "acknowledgement": "acknowledgment",
    "merchantibility": "merchantability",
    "per cent": "percent",
    "favour": "favor",
    " http ": " https ",
}

COPYRIGHT_LINE = r"^[ \t]*(copyright[ \t]*([(]c[)]|©|[0-9]{4})|[(]c[)][ \t]*[0-9]{4}|©|all rights reserved)[^\n]*$"
#: The same in files: behind comment marks, and with a name in place of the year. The words are those that follow in running text.
_BEFORE = r"^[^\p{L}\p{N}\n(©]*"
_DATED = r"copyright[ \t:]*([(]c[)]|©|[0-9]{4})"
_OTHERS = r"[(]c[)][ \t]*[0-9]{4}|©|all rights reserved"
_RUNNING = r"(notices?|holders?|owners?|licen[sc]es?|laws?|statements?|status|interests?|claims?|infringement|disclaimers?|permission|treaty|protection|rights?|the (software|program|library)|and|or|on|in|of|to|is|by|for|that|which|as|under|with)\b"
COPYRIGHT_IN_FILE = rf"{_BEFORE}({_DATED}|copyright[ \t:]+(?!{_RUNNING})[\[<{{\p{{L}}]|{_OTHERS})[^\n]*$"
OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column, copyright_line: str = COPYRIGHT_LINE) -> Column:
    out = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    out = F.regexp_replace(out, "(?dm)" + copyright_line, "")
    out = F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), OTHER, " ")
    for spelling, one in SPELLINGS.items():
        out = F.replace(out, F.lit(spelling), F.lit(one))
    return F.trim(out)


def canonical_digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def file_digest(text: Column) -> Column:
    return F.sha2(canonical(text, COPYRIGHT_IN_FILE), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id, text of the licences above, bare and with their titles."""
    rows = BODIES + [(k, f"{title}\n{body}") for k, body in BODIES for title in TITLES[k]]
    for k, name in FILES.items():
        whole = pkgutil.get_data("siftline.llm", f"license_texts/{name}.txt").decode()
        rows += [(k, part) for part in {whole, whole.split(APPENDIX[k])[0] if k in APPENDIX else whole}]
    return spark.createDataFrame(rows, "license_id string, text string")


#: Only texts with one of these (in lower case) have a second form of their own.
_MARKS = "copyright|[(]c[)]|©|all rights reserved"


def find_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id of each document; of several known texts with one digest the least id.

    A caller's own ``known`` may be of any size: then digests are joined by shuffles, and groups of equal texts however large stay where they are.
    """
    built_in = known is None
    texts = known_licenses(docs.sparkSession) if built_in else known
    text = F.col("text")
    marked = F.lower(F.coalesce(text, F.lit(""))).rlike(_MARKS)
    own = docs.select("doc_id", canonical_digest(text).alias("digest"), F.when(marked, file_digest(text)).alias("as_file"))
    forms = texts.select("license_id", canonical_digest(text).alias("digest"), file_digest(text).alias("as_file"))

    def ids(key: str, name: str) -> DataFrame:
        return forms.groupBy(key).agg(F.min("license_id").alias(name))

    whole, filed = ids("digest", "whole"), ids("as_file", "filed")
    if built_in:  # the number of texts above bounds what is broadcast
        whole, filed = F.broadcast(whole), F.broadcast(filed)
        own = own.withColumn("second", F.coalesce("as_file", "digest")).drop("as_file")
        found = own.join(whole, "digest", "left").join(filed.withColumnRenamed("as_file", "second"), "second", "left")
        return found.select("doc_id", "digest", F.coalesce("whole", "filed").alias("license_id"))
    # rows meet the known texts by what they are, not one by one: each distinct pair of digests is looked up once
    own = materialise(own.withColumn("second", F.coalesce("as_file", "digest")).drop("as_file"), "licence-rows")
    groups = own.groupBy("digest", "second").agg(F.count(F.lit(1)).alias("copies"))
    groups = groups.join(whole, "digest", "left").join(filed.withColumnRenamed("as_file", "second"), "second", "left")
    named = groups.select(F.concat("digest", "second").alias("both"), "copies", F.coalesce("whole", "filed").alias("license_id"))
    rows = own.withColumn("both", F.concat("digest", "second")).drop("second")
    return join_groups(rows, materialise(named, "licence-groups"), "both", "copies").select("doc_id", "digest", "license_id")


def sql() -> str:
    """The same known texts and both forms over the table ``documents``, in DuckDB's dialect, which cannot look ahead: lines are judged one by one."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def form(x: str, drop: str) -> str:
        out = f"translate(coalesce({x}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
        out = f"array_to_string(list_transform(string_split({out}, chr(10)), lambda l: CASE WHEN {drop} THEN '' ELSE l END), chr(10))"
        out = f"regexp_replace(replace({out}, '&', ' and '), {quoted(OTHER)}, ' ', 'g')"
        for spelling, one in SPELLINGS.items():
            out = f"replace({out}, {quoted(spelling)}, {quoted(one)})"
        return f"sha256(trim({out}))"

    def has(pattern: str) -> str:
        return f"regexp_matches(l, {quoted(pattern)})"

    line = has(COPYRIGHT_LINE)
    in_file = f"({has(f'{_BEFORE}({_DATED}|{_OTHERS})')} OR {has(_BEFORE + r'copyright[ \t:]+[\[<{\p{L}]')} AND NOT {has(_BEFORE + r'copyright[ \t:]+' + _RUNNING)})"
    bodies = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in BODIES)
    titles = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, own in TITLES.items() for t in own)
    files = []
    for k, name in FILES.items():
        whole = pkgutil.get_data("siftline.llm", f"license_texts/{name}.txt").decode()
        files += [f"({quoted(k)}, {quoted(part)})" for part in {whole: 0, (whole.split(APPENDIX[k])[0] if k in APPENDIX else whole): 0}]
    return f"""WITH bodies(license_id, text) AS (VALUES {bodies}), titles(license_id, title) AS (VALUES {titles}), files(license_id, text) AS (VALUES {', '.join(files)}),
every AS (SELECT * FROM bodies UNION ALL SELECT license_id, title || chr(10) || text FROM bodies JOIN titles USING (license_id) UNION ALL SELECT * FROM files),
known AS (SELECT {form('text', line)} AS digest, min(license_id) AS whole FROM every GROUP BY 1), filed AS (SELECT {form('text', in_file)} AS second, min(license_id) AS filed FROM every GROUP BY 1),
own AS (SELECT doc_id, {form('text', line)} AS digest, {form('text', in_file)} AS second FROM documents)
SELECT doc_id, digest, coalesce(whole, filed) AS license_id FROM own LEFT JOIN known USING (digest) LEFT JOIN filed USING (second)"""
