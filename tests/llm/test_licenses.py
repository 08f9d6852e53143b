import math
import re
from collections import Counter

import pytest

from marlstone.llm import licenses as L

FILES = [
    ("a/LICENSE", "MIT License\n\n" + L.TEMPLATES[3][1]),
    ("a/x.txt", "nothing here"),
    ("a/b/y.txt", "Licensed under CC BY-NC 4.0.\nand more of the text"),
    ("a/b/c/z.txt", None),
    ("a/b/copying.md", L.TEMPLATES[9][1].replace(", ", ",\n")),
    ("q/r/s.txt", "a license to thrill is not a notice"),
    ("q/t.txt", "x " * 50 + "\nReleased under the MIT License.\n" + "y " * 50),
    ("top.txt", ""),
    ("w/1.txt", "before it\nDedicated to the public\ndomain under CC0 1.0 Universal.\nafter it"),
    ("w/2.txt", "All rights  reserved."),
    ("w/3.txt", "one two\nAll rights\nreserved.\nthree four five six"),
    ("w/4.txt", "x\nThis work is licensed\nunder the GNU General\nPublic License, version 3.\n" + "z\n" * 60),
    ("a/x.txt", "nothing here"),
    (None, "Released under the MIT License."),
    ("z/1.txt", "some words\nReleased under the MIT License.\nmore"),
    ("z/1.txt", "some words\nReleased under the MIT License.\nmore"),
    ("z/1.txt", "Released under nothing at all, and so on"),
    ("v/1.txt", "\n \nfirst words of it\n \n\t\n\nThis work\nis licensed\nunder the GNU\nGeneral Public\nLicense, version 3.\n\r\n\nlast words of it"),
    ("v/2.txt", "All\n\nrights reserved."),
    ("v/3.txt", "Public \u212a domain \u0130 under CC0\n" + "public notice " * 40),
    ("v/4.txt", "a b c d e\n" * 5 + "\x0b\nAll rights reserved.\n\x0b\n" + "f g h i\n" * 5),
]


def slow_scan(files, whole_texts):
    texts = [t for _, t in files if t is not None]
    words = lambda t: [x for x in re.split("[^a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) if x]
    df = Counter(x for t in texts for x in set(words(t)) & set(L.VOCABULARY))
    idf = lambda t: math.log((1 + len(texts)) / (1 + df[t])) + 1

    def vec(t):
        w = {k: c * idf(k) for k, c in Counter(words(t)).items()}
        n = math.sqrt(sum(x * x for x in w.values())) or 1
        return {k: x / n for k, x in w.items()}

    own = {}
    for p, t in files:
        lines = (t or "").split("\n")
        runs = ["\n".join(lines[i : i + k]) for k in (2, 3) for i in range(len(lines) - k + 1)]
        parts, notes = [[]], [[]]
        for i, x in enumerate(lines):
            if not re.search("[A-Za-z0-9]", x):
                parts.append([])
            if i and bool(re.search(L.COMMENT, x.lower())) != bool(re.search(L.COMMENT, lines[i - 1].lower())):
                notes.append([])
            parts[-1].append(x)
            notes[-1].append(x)
        more = ["\n".join(x) for x in parts + notes]
        for s in ([t] + lines + runs + more + re.split(r"\n[ \t\r]*\n", t)) if t and p else []:
            v = vec(s)
            for i, (name, x) in enumerate(L.TEMPLATES):
                u = vec(x)
                c = round(sum(v[k] * u[k] for k in v.keys() & u.keys()), 6)
                if c >= L.THRESHOLD and not (set(L.TELLING.get(name, ())) & u.keys()) - v.keys():
                    a = own.setdefault(p, [(0, 0, ""), False])
                    a[0] = max(a[0], (c, -i, name))
                    a[1] |= s is t
    out = {}
    for p, t in files:
        if p in own:
            out[p] = (own[p][0][2], "own", None)
            continue
        out[p] = (None, None, None)
        d = p.rpartition("/")[0] if p else None
        while d is not None:
            h = [(v[0][0], v[0][2], q) for q, v in own.items() if q.rpartition("/")[0] == d and (whole_texts and v[1] or re.search(L.LICENCE_FILE, q))]
            if h:
                out[p] = (max(h)[1], "inherited", max(h)[2])
                break
            d = d.rpartition("/")[0] if d else None
    return out


@pytest.mark.parametrize("whole", [False, True])
def test_equal_slow_form(spark, whole):
    df = spark.createDataFrame([(p, t, "k") for p, t in FILES], "path string, text string, licence string").repartition(3)
    rows = L.scan(df, whole).collect()
    assert len(rows) == len(FILES)
    got = {r.path: (r.licence, r.origin, r.licence_file) for r in rows}
    assert got == slow_scan(FILES, whole)
    assert got["a/b/c/z.txt"] == ("GPL-3.0", "inherited", "a/b/copying.md") and got["a/x.txt"][0] == "MIT" and got["q/t.txt"] == ("MIT", "own", None)
    assert [got[f"w/{i}.txt"][:2] for i in (1, 2, 3, 4)] == [("CC0-1.0", "own"), ("Proprietary", "own"), ("Proprietary", "own"), ("GPL-3.0", "own")]
    assert L.scan(df.limit(0), whole).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.path: r.licence for r in L.scan(L.document_files(docs)).collect()}
    marks = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for r in docs.collect():
        for m, name in marks.items():
            if m in r.text.split("\n"):
                assert got[f"{r.source}/{r.lang}/{r.doc_id}"] == name


HEADERS = {
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "GPL-3.0": """Foobar is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

Foobar is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with Foobar.  If not, see <https://www.gnu.org/licenses/>.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Affero General Public License for more details.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.""",
    "LGPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "MIT": L._MIT_WHOLE,
    "BSD-2-Clause": L._BSD + "\n\n" + L._BSD_REST.strip(),
    "BSD-3-Clause": L._BSD.replace(": 1.", ":\n\n1.").replace(" 2. ", "\n2. ") + "\n" + L._BSD_THIRD.strip() + "\n\n" + L._BSD_REST.strip(),
}


def test_every_header_gets_its_own_name(spark):
    import textwrap

    code = "\ndef main(argv):\n    return run(argv, depth=3)\n\n\nclass Walker:\n    pass\n" * 3
    files = []
    for name, text in HEADERS.items():
        wrapped = "\n\n".join(textwrap.fill(" ".join(p.split()), 50) for p in text.split("\n\n"))
        for kind, mark in (("plain", ""), ("hash", "# "), ("slash", "// "), ("star", " * ")):
            for form, body in (("given", text), ("wrapped", wrapped)):
                lines = "\n".join((mark + x).rstrip() if mark else x for x in body.split("\n"))
                files.append((f"src/{name}/{kind}-{form}", ("/*\n" + lines + "\n */" if kind == "star" else lines) + (code if mark else "\n" + code)))
    files += [(f"other/{i}", f"plain words of a file number {i} and the license of the program you may use") for i in range(60)]
    got = {r.path: r.licence for r in L.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    wrong = {p: v for p, v in got.items() if p.startswith("src/") and v != p.split("/")[1]}
    assert not wrong
    assert all(v is None for p, v in got.items() if p.startswith("other/"))
