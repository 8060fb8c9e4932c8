"""Licence scans: canonical digests of entire texts, hash-joined to the digests of known licences.

A text is made canonical before it is digested: lower case, copyright lines and lines of rights reserved taken out,
punctuation and white space folded to one space, equivalent spellings made one. So the digest is the same however a
licence is wrapped, indented or quoted. A document whose entire text is a known licence gets its id: short licences are
known by their texts, with the usual headings or none, and long ones by the digests of their published texts. The lines of a
document are texts of their own: those that are a known notice ("Released under the MIT License.") give the notice ids.

Digests of licences and notices come from the same expression over the known texts. Only lines as long as a known
notice are digested. There is no shuffle unless the table of licences is too large to broadcast.

Defined results: a null text is an empty one; a text without letters or digits is no licence. A digest that several ids
share gives the first id. Repeated rows give repeated rows; an empty table gives an empty result. Further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.shared import small_or_shuffled

#: Lines that aren't part of a licence's words. Patterns, of lower-case text.
COPYRIGHT = r"^[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©|[0-9<\[{]|by )|\(c\)[ \t]*[0-9<\[{]|©|all rights reserved)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
#: Equivalent spellings, after punctuation is gone. Fixed values.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"),
    ("copyright holder", "copyright owner"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("favour", "favor"),
    ("colour", "color"), ("honour", "honor"), ("centre", "center"), ("organisation", "organization"), ("authoris", "authoriz"),
    ("recognis", "recogniz"), ("utilis", "utiliz"), ("merchantibility", "merchantability"), ("whilst", "while"), ("fulfilment", "fulfillment"),
    ("https ", "http "),
)

#: Those of several words.
DIVISIBLE = tuple(pair for pair in SPELLINGS if " " in pair[0].strip())

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Texts of licences. Fixed values.
LICENSES = {
    "MIT": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_WARRANTY} OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

{_ISC_WARRANTY}""",
    "0BSD": f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

{_ISC_WARRANTY}""",
    "BSD-2-Clause": f"{_BSD_HEAD}\n{_BSD_TAIL}",
    "BSD-3-Clause": f"""{_BSD_HEAD}
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
{_BSD_TAIL}""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": f"""This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

{_WARRANTY} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
#: Headings that these texts come with, besides none. Fixed values.
HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"),
    "Zlib": ("zlib License", "The zlib License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
}
#: Digests of the canonical forms of published texts: the whole, and up to the end of the terms where more follows. Fixed values.
DIGESTS = {
    "Apache-2.0": ("e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0",),
    "Artistic-1.0-Perl": ("bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93",),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "GFDL-1.2": ("66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e",),
    "GFDL-1.3": ("525fd4384869c81c4cbd264822942ae15202284aed28fb120ba01fc119dda9ff",),
    "GPL-1.0": ("37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9",),
    "GPL-2.0": ("ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0",),
    "GPL-3.0": ("ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8", "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b",),
    "LGPL-2.0": ("bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389",),
    "LGPL-2.1": ("ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97",),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",),
    "MPL-2.0": ("f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",),
}


def license_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the short licences, bare and with each heading."""
    return [(i, head + text) for i, text in LICENSES.items() for head in ("", *(h + "\n\n" for h in HEADINGS[i]))]


def pinned() -> list[tuple[str, str]]:
    """(license_id, digest) of the long ones."""
    return [(i, digest) for i, digests in DIGESTS.items() for digest in digests]


#: Names that notices give licences. Fixed values.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License",),
    "0BSD": ("Zero-Clause BSD License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "Zlib": ("zlib License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"),
    **{f"{short}-{v}.0": (f"GNU {long} General Public License, version {v}".replace("  ", " "), f"{short} version {v}", f"{short}v{v}") for short, long in (("GPL", ""), ("LGPL", "Lesser"), ("AGPL", "Affero")) for v in (2, 3)},
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    **{f"CC-{kind}-{v}": (f"CC {kind} {v}", f"CC-{kind} {v}") for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")},
}
#: Notices, of which each name makes one.
NOTICES = ("Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "This work is licensed under {}", "This work is licensed under the {}")


def notice_texts() -> list[tuple[str, str]]:
    """(license_id, notice) for every name and form, and the tag of each id."""
    named = [(i, form.format(name)) for i, names in NAMES.items() for name in names for form in NOTICES]
    return named + [(i, f"SPDX-License-Identifier: {i}") for i in NAMES]


def canonical(text: Column) -> Column:
    """Canonical lines of a text, one below the other."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?md)" + COPYRIGHT, "")
    text = F.regexp_replace(text, PUNCTUATION, " ")
    for own, one in SPELLINGS:
        text = F.replace(text, F.lit(own), F.lit(one))
    return text


def whole(lines: Column) -> Column:
    """Canonical lines as one line, with the spellings of several words that a line's end had divided."""
    text = F.trim(F.regexp_replace(lines, "[ \n]+", " "))
    for own, one in DIVISIBLE:
        text = F.replace(text, F.lit(own), F.lit(one))
    return text


def known_table(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """(digest, license_id, length) of known texts."""
    one = whole(canonical(F.col("text")))
    rows = spark.createDataFrame(texts, "license_id string, text string").select("license_id", one.alias("one")).filter("one <> ''")
    return rows.groupBy(F.sha2("one", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.first(F.length("one")).alias("length"))


def default_table(spark: SparkSession) -> DataFrame:
    """(digest, license_id) of the licences, long and short, and the notices."""
    made = known_table(spark, [*license_texts(), *notice_texts()]).select("digest", "license_id")
    return made.unionByName(spark.createDataFrame([(d, i) for i, d in pinned()], "digest string, license_id string")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", licenses: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, text_digest, license_id (of the entire text, or null), notice_ids (joined by commas).

    ``licenses``: a table like that of ``known_table``, of any size; by default that of ``default_table``.
    """
    spark = docs.sparkSession
    notices = known_table(spark, notice_texts()).collect()  # one for each name and form above
    licenses = default_table(spark) if licenses is None else licenses
    ids = F.create_map(*(F.lit(x) for n in notices for x in (n.digest, n.license_id)))
    lengths = sorted({n.length for n in notices})
    rows = docs.select(F.col(doc_id).alias("doc_id"), canonical(F.col(text)).alias("lines"))
    lines = F.transform(F.split("lines", "\n"), lambda line: F.trim(line))
    found = F.transform(F.filter(lines, lambda line: F.length(line).isin(lengths)), lambda line: F.try_element_at(ids, F.sha2(line, 256)))
    rows = rows.select("doc_id", F.sha2(whole(F.col("lines")), 256).alias("text_digest"), F.array_join(F.array_sort(F.array_distinct(F.array_compact(found))), ",").alias("notice_ids"))
    known = small_or_shuffled(licenses.select(F.col("digest").alias("known"), "license_id"))
    return rows.join(known, F.col("text_digest") == F.col("known"), "left").select("doc_id", "text_digest", "license_id", "notice_ids")
