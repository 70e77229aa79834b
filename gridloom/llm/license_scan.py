"""License scan by canonical digests, in DataFrame functions only.

A text is made canonical: lower case, copyright lines out, anything but
letters and digits a single space, equivalent spellings made one.  Its SHA-256
is hash-joined to the digests of known licences, which are made the same way.
So is each single line that starts as a known text does, to find notices inside
texts; no spelling rule touches the first three letters of a text.

The registry is a DataFrame of ``license_id, text``, and maybe ``digest, starts``
where a text is known by its digest and first letters only;
:func:`builtin_registry` gives short public licences, usual notices and the
digests of long licences.  A registry of at most
``broadcast_rows`` rows (its digests are 64 bytes each) is broadcast after that
check; a larger one is joined by shuffle.

Defined cases: a null text has a null digest and matches nothing; an empty one
has the digest of the empty text, which no licence has (empty registry texts
are left out); of several licences with the same canonical text the smallest id
is given; repeated rows stay; only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (pattern, replacement) over canonical words; a group 1 is the start of the text or a space.
SPELLINGS = [
    (r"(^| )(sub)?licence", r"$1$2license"),
    (r"(^| )(organ|author|recogn|util)is(ation|ed|ing|e)", r"$1$2iz$3"),
    (r"(^| )(fav|col|hon|behavi)our", r"$1$2or"),
    (r"(^| )sub license", r"$1sublicense"),
    (r"(^| )non commercial", r"$1noncommercial"),
    (r"(^| )copyright owner", r"$1copyright holder"),
    (r"(^| )https ", r"$1http "),
    (r"(^| )per cent ", r"$1percent "),
    (r"(^| )judgement", r"$1judgment"),
    (r"(^| )wilful", r"$1willful"),
]
#: A notice: copyright with a sign or a year, (c) with a year, a sign, or the reservation of rights alone; after a comment's mark or not.
COPYRIGHT = r"(^|\n)[ \t]*((#+|//+|/?\*+|--+|;+|%+|<!--)[ \t]*)?(copyright[ \t]*(\(c\)|©|&copy;)[^\n]*|copyright\b[^\n]*\b(19|20)[0-9][0-9]\b[^\n]*|\(c\)[^\n]*\b(19|20)[0-9][0-9]\b[^\n]*|©[^\n]*|all rights reserved[^\p{L}\p{N}\n]*(?=\n|$))"
#: The patterns of :func:`oracle_sql`, which has only notices at the start of a line and lines with one of these words.
SQL_COPYRIGHT = r"(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
MENTION = "(?i)licen[cs]|permission"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ISC = f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"
ZERO_BSD = f"{_ISC_GRANT}.\n\n{_ISC_WARRANTY}"

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_REGISTRY = [
    ("MIT", MIT), ("MIT", f"MIT License\n\n{MIT}"), ("MIT", f"The MIT License (MIT)\n\n{MIT}"), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("ISC", ISC), ("ISC", f"ISC License\n\n{ISC}"), ("0BSD", ZERO_BSD),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_HEAD}{_BSD_TAIL}"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL), ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_HEAD}{_BSD_THIRD}{_BSD_TAIL}"),
    ("Zlib", ZLIB), ("Zlib", f"zlib License\n\n{ZLIB}"),
    ("Apache-2.0", APACHE_NOTICE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]


#: Digests, and first letters, of the canonical whole texts of long licences.
_WHOLE = [
    ("Apache-2.0", "6074c3536c43b739207170b87d1681477d0f07374ed3d862ba461334cce848e3", "apa"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe", "apa"),  # without its appendix
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702", "the"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "cre"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60", "gnu"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826", "gnu"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", "gnu"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", "gnu"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", "gnu"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", "gnu"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "gnu"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "gnu"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b", "moz"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d", "moz"),
]


def builtin_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, None, None) for i, t in _REGISTRY] + [(i, None, d, p) for i, d, p in _WHOLE], "license_id string, text string, digest string, starts string")


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), F.lit(COPYRIGHT), F.lit("\n"))
    out = F.trim(F.regexp_replace(out, F.lit(r"[^\p{L}\p{N}]+"), F.lit(" ")))
    for pattern, replacement in SPELLINGS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(replacement))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(registry: DataFrame) -> DataFrame:
    """``_d, _l, _p``: a row for each digest, with up to three letters that its text starts with."""
    ready = {"digest", "starts"} <= set(registry.columns)
    given = [F.col(c).cast("string").alias(a) if ready else F.lit(None).cast("string").alias(a) for c, a in (("digest", "d"), ("starts", "p"))]
    rows = registry.select(canonical(F.col("text").cast("string")).alias("c"), F.col("license_id").cast("string").alias("l"), *given).where("c <> '' or d is not null")
    rows = rows.select(F.coalesce("d", F.sha2("c", 256)).alias("_d"), "l", F.coalesce("p", F.regexp_extract("c", "^[^ ]{1,3}", 0)).alias("p"))
    return rows.groupBy("_d").agg(F.min("l").alias("_l"), F.min("p").alias("_p"))


def scan(docs: DataFrame, registry: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500) -> DataFrame:
    """``id_col, digest, license_id, notices`` of each row.

    ``license_id`` is the licence that the whole text is; ``notices`` are the
    licences of single lines, sorted and comma-joined (empty if there are none).
    """
    text = F.col(text_col).cast("string")
    known = known_digests(registry)
    some = known.limit(broadcast_rows + 1).collect()  # digests and first letters only
    small = len(some) <= broadcast_rows
    lines = F.split(text, "\n")
    if small:
        starts = r"^[^\p{L}\p{N}]*(" + "|".join(sorted({r._p for r in some})) + ")" if some else r"^\b\B"
        lines = F.filter(lines, lambda x: F.lower(x).rlike(starts))
    lines = F.transform(lines, digest)
    rows = docs.select(F.col(id_col).alias("_id"), digest(text).alias("digest"), F.coalesce(lines, F.array().cast("array<string>")).alias("_lines"))
    if small:
        held = known.agg(F.map_from_entries(F.collect_list(F.struct("_d", "_l"))).alias("_m"))
        rows = rows.join(F.broadcast(known), rows.digest == known._d, "left").crossJoin(F.broadcast(held))  # one row of a bounded map
        found = F.filter(F.transform("_lines", lambda d: F.try_element_at("_m", d)), lambda x: x.isNotNull())
        rows = rows.withColumn("_found", found)
    else:
        keyed = rows.withColumn("_row", F.monotonically_increasing_id())
        hits = keyed.select("_row", F.explode(F.array_distinct("_lines")).alias("_x")).join(known, F.col("_x") == F.col("_d")).groupBy("_row").agg(F.collect_set("_l").alias("_found"))
        rows = keyed.join(known, keyed.digest == known._d, "left").join(hits, "_row", "left")
    return rows.select(F.col("_id").alias(id_col), "digest", F.col("_l").alias("license_id"), F.array_join(F.array_sort(F.array_distinct(F.coalesce("_found", F.array().cast("array<string>")))), ",").alias("notices"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the whole documents table against the built-in registry."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), builtin_registry(spark))


def _canonical_sql(x: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(lower({x}), {quoted(SQL_COPYRIGHT)}, chr(10), 'g')"
    out = f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for pattern, replacement in SPELLINGS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(replacement.replace('$', chr(92)))}, 'g')"
    return out


def oracle_sql() -> str:
    """DuckDB SQL for :func:`query`."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in _REGISTRY)
    ready = ", ".join(f"('{d}', '{i}')" for i, d, _ in _WHOLE)
    return f"""
with registry(license_id, t) as (values {values}),
every as (select sha256({_canonical_sql('t')}) as d, license_id as i from registry union all select * from (values {ready})),
known as (select d, min(i) as l from every group by 1),
lines as (select doc_id, unnest(string_split(text, chr(10))) as x from documents),
hits as (select doc_id, string_agg(distinct l, ',' order by l) as notices
         from (select doc_id, sha256({_canonical_sql('x')}) as d from lines where regexp_matches(x, '{MENTION}')) join known using (d) group by 1)
select doc_id, sha256({_canonical_sql('text')}) as digest, l as license_id, coalesce(notices, '') as notices
from documents left join known on d = sha256({_canonical_sql('text')}) left join hits using (doc_id)"""
