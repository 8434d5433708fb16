import re
import textwrap

import pytest

from reasonloom.llm import licenses, queries


def test_query_equals_its_sql(spark, duck, medium_dir):
    got = {tuple(r) for r in queries.op9_license_scan(spark, medium_dir).collect()}
    wanted = set(duck(medium_dir).execute(queries.ORACLE["op9_license_scan"]).fetchall())
    assert got == wanted and got


def plain(text):
    """Licence and coefficient of every unit of a text, by comparing it with all templates."""
    cuts = re.sub(r"([.!?:])[ \t]+", "\\1\n", text.replace("\n", " "))
    best = {}
    paragraphs = re.split(r"\n[ \t\r]*\n", text)
    for unit in {*text.split("\n"), *cuts.split("\n"), *paragraphs, text}:
        a = set(licenses.bigrams_of(unit))
        scores = []
        for name, template in licenses.TEMPLATES:
            b = set(licenses.bigrams_of(template))
            scores.append((-2 * len(a & b) / max(len(a) + len(b), 1), name))
        minus, name = min(scores)
        if minus <= -0.8:
            best[name] = max(best.get(name, 0), round(-minus, 6))
    if "bsd-3-clause" in best:
        best.pop("bsd-2-clause", None)
    return best


def wrapped(*paragraphs, width=72):
    return "\n\n".join(textwrap.fill(p, width) for p in paragraphs)


HOLDER = "Copyright (c) 2019 Some Holder and others"
LICENSES = {
    "mit": wrapped("MIT License", HOLDER, licenses.MIT_GRANT, *licenses.MIT_REST.split(" THE SOFTWARE IS ", 1)),
    "isc": wrapped("ISC License", HOLDER, licenses.ISC_GRANT, licenses.ISC_REST),
    "bsd-2-clause": wrapped("BSD 2-Clause", HOLDER, licenses.BSD_HEAD, licenses.BSD_REST),
    "bsd-3-clause": wrapped(HOLDER, licenses.BSD_HEAD, licenses.BSD_THIRD, licenses.BSD_REST),
    "apache-2.0": wrapped(
        HOLDER, 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
        "in compliance with the License. You may obtain a copy of the License at", "    http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is '
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."),
    "gpl-2.0": wrapped(HOLDER, "This program is free software; " + licenses.GNU.format("General", "Foundation;", "2")),
    "gpl-3.0": wrapped(HOLDER, "Foo is free software: " + licenses.GNU.format("General", "Foundation,", "3")),
    "lgpl-2.1": wrapped(HOLDER, "This library is free software; " + licenses.GNU.format("Lesser General", "Foundation;", "2.1")),
    "lgpl-3.0": wrapped(HOLDER, "Foo is free software: " + licenses.GNU.format("Lesser General", "Foundation,", "3")),
    "agpl-3.0": wrapped(HOLDER, "This program is free software: " + licenses.GNU.format("Affero General", "Foundation,", "3")),
}
TAIL = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
    "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)


def test_whole_licences_are_told_apart(spark):
    story = "We went to the market and bought apples. Nobody asked for a licence there."
    rows = [(10 * k, text) for k, text in enumerate(LICENSES.values())]
    rows += [(10 * k + 1, f"{story}\n\n{text}\n\n{TAIL}\n\n{story}") for k, text in enumerate(LICENSES.values())]
    rows += [(10 * k + 2, "\n".join(f" * {x}" for x in text.split("\n"))) for k, text in enumerate(LICENSES.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in licenses.scan(docs).collect():
        found.setdefault(r.doc_id, set()).add(r.license_id)
    names = list(LICENSES)
    assert found == {doc_id: {names[doc_id // 10]} for doc_id, _ in rows}


def test_a_changed_notice_keeps_its_version(spark):
    rows = []
    for k, (name, text) in enumerate(LICENSES.items()):
        changed = text.replace("This program", "Our little tool").replace("This library", "Our code").replace("it and", "them and")
        rows.append((k, changed))
    found = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == dict(enumerate(LICENSES))


CASES = [
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
    ("text before\nReleased under the MIT License.\ntext after", {"mit"}),
    ("Foo bar. This work is licensed under the GNU General\nPublic License, version 3. More.", {"gpl-3.0"}),
    ("This work is licensed under the GNU General Public License, version 2.", {"gpl-2.0"}),
    ("licensed   UNDER cc-by-nc 4.0", {"cc-by-nc-4.0"}),
    ("Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0.", {"cc-by-4.0", "cc-by-sa-4.0"}),
    ("We discuss the license of the general public at length in this work of ours today.", set()),
    ("All rights reserved.", {"all-rights-reserved"}),
    ("all rights", set()),
]


@pytest.mark.parametrize("text, names", CASES)
def test_wordings(text, names):
    assert set(plain(text)) == names


def test_scan_equals_the_plain_comparison(spark):
    rows = [(k, text) for k, (text, _) in enumerate(CASES)]
    rows += [(100 + k, text) for k, (_, text) in enumerate(licenses.TEMPLATES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license_id): r.dice for r in licenses.scan(docs).collect()}
    assert got == {(k, name): dice for k, text in rows for name, dice in plain(text).items()}


def test_signature_words_miss_nothing():
    """Any unit that keeps just enough bigrams of a template holds a signature word."""
    cfg = licenses.LicenseConfig()
    chosen = set(licenses.signature_words(cfg))
    for _, template in cfg.templates:
        pairs = licenses.bigrams_of(template)
        bare = [p for p in pairs if not chosen & set(p.split())]
        # a unit of bigrams without such words alone, no longer than needed
        assert 2 * len(bare) / (len(bare) + len(pairs)) < cfg.threshold


def test_odd_rows(odd_documents):
    rows = licenses.scan(odd_documents).collect()
    assert [tuple(r) for r in rows] == [(11, "apache-2.0", 1.0)]
    assert licenses.scan(odd_documents.limit(0)).count() == 0


def test_native_plan(small_documents):
    plan = licenses.scan(small_documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Join", plan)
