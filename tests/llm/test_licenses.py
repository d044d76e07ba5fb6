"""Whole notices, wrapped and commented; nested rules."""

from ledgerloom.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""


def commented(text, mark):
    return "".join(f"{mark} {line}".rstrip() + "\n" for line in text.splitlines())


def test_wrapped_notices_and_nested_rules(spark):
    cases = [
        (MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD + THIRD, "BSD-3-Clause"), (GPL, "GPL-3.0-or-later"), (commented(MIT, " *"), "MIT"), (commented(BSD + THIRD, "//"), "BSD-3-Clause"),
        (commented(GPL, "#"), "GPL-3.0-or-later"), ("Copyright (c) 2020 A. Person\n" + MIT, "MIT"), (BSD + THIRD + "\n" + BSD, "BSD-2-Clause,BSD-3-Clause"),
        ("Some line\nLicensed under CC BY 4.0\nanother line", "CC-BY-4.0"), ("not licensed under the mit license at all", ""), ("", ""), (None, ""), ("x\n" * 5000 + "all rights reserved", "Proprietary"),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan(docs).collect()} == {i: name for i, (_, name) in enumerate(cases)}


def test_rules_name_known_sentences_only():
    used = {i for _, ids in licenses.RULES for i in ids}
    assert used <= set(licenses.SENTENCES) and len(set(licenses.SENTENCES.values())) == len(licenses.SENTENCES)
