"""Standard notices, titles and short licence texts, as single lines, as wrapped comments and as licence files."""

import textwrap

from lectern.llm import licenses

GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version."
)
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"


def wrapped(text, mark=" * "):
    return "\n".join(mark + x for x in textwrap.wrap(text, 70))


def test_standard_notices_are_found(spark):
    cases = [
        (GPL, "GPL-3.0"), (f"/*\n * Copyright 2020 Foo\n *\n{wrapped(GPL)}\n */\nint x;", "GPL-3.0"), (wrapped(GPL.replace("version 3", "version 2")), "GPL-2.0"),
        ("GNU GENERAL PUBLIC LICENSE", "GPL"), ("   GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n", "GPL-3.0"), ("MIT License", "MIT"),
        ("Copyright 2020 Foo. All rights reserved.", "Proprietary"), (ISC, "ISC"), (wrapped(ISC, "# "), "ISC"), (wrapped(EPL, "// "), "EPL-2.0"),
        ("some words of prose about a program\nand more of them in a second line", None),
    ]
    rows = [(i, f"d{i}/f.c", t) for i, (t, _) in enumerate(cases)]
    texts = {"BSD-2-Clause": licenses._BSD2 + licenses._DISCLAIMER, "BSD-3-Clause": licenses._BSD2 + licenses._BSD3 + licenses._DISCLAIMER, "MIT": licenses._MIT + licenses._MIT_REST}
    rows += [(100 + i, f"e{i}/LICENSE", f"Copyright (c) 2020 Foo\n\n{wrapped(t, '')}") for i, t in enumerate(texts.values())]
    fill = [(1000 + i, f"z/{i}.txt", f"filler words number {i} with nothing to declare") for i in range(200)]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows + fill, "doc_id long, path string, text string")).collect()}
    assert {i: got[i] for i in range(len(cases))} == {i: w for i, (_, w) in enumerate(cases)}
    assert [got[100 + i] for i in range(len(texts))] == list(texts)
    assert not any(got[i] for i, *_ in fill)
