"""License scans: candidate blocks compressed with each template as dictionary; wording differences confirm the winner."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Names of licences and the usual wording of their notices. {} stands for names, years and places.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "BSD-3-Clause": "Released under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "Licensed under CC0 1.0. This work is dedicated to the public domain under CC0 1.0 Universal.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "LicenseRef-All-Rights-Reserved": "All rights reserved. No part of this publication may be reproduced without permission.",
}
#: Words without which no template's wording is there, line breaks and comment marks between them or not; a block is what
#: stands around lines that have one.
CUES = r"(?i)licen[sc]e|rights\W+reserved|copyright|creative\W+commons|public\W+domain|\bcc\W{0,8}(by|0)|permission\W+is\W+hereby|redistribution\W+and\W+use|permission\W+to\W+use"
_CUE = re.compile(CUES)
_OTHER = re.compile(r"\d|^(by|nc|sa|nd|lesser|affero)|^(apache|mit|bsd|gnu|mozilla|creative|unencumbered)$")
_FAMILY = re.compile(r"^(lesser|affero|library)")
_SOLID = re.compile(r"[^\W_]")
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


#: Words of a block before and after a line with a cue: more than the longest sentence of a template.
AROUND = 80


def blocks_of(text: str) -> list[tuple[int, str]]:
    """(first line with a cue, text) of every block: lines with a cue and up to AROUND words of their paragraph on both sides.

    Lines without letters or digits part paragraphs. Lines with a cue whose surroundings meet are one block.
    """
    lines = text.split("\n")
    cue = [False] * len(lines)
    at = n = 0
    for m in _CUE.finditer(text):
        n += text.count("\n", at, m.start())
        at = m.start()
        for k in range(n, n + m.group().count("\n") + 1):
            cue[k] = True
    out: list[tuple[int, str]] = []
    n = 0
    while n < len(lines):
        if not cue[n]:
            n += 1
            continue
        before: list[str] = []
        left, k = AROUND, n - 1
        while left > 0 and k >= 0 and not cue[k] and _SOLID.search(lines[k]):
            before.insert(0, " ".join(lines[k].split()[-left:]))
            left -= len(before[0].split())
            k -= 1
        block, left, k = [lines[n]], AROUND, n + 1
        while k < len(lines) and (cue[k] or left > 0 and _SOLID.search(lines[k])):
            if cue[k]:
                block.append(lines[k])
                left = AROUND
            else:
                block.append(" ".join(lines[k].split()[:left]) if not any(cue[k + 1 : k + 2]) else lines[k])
                left -= len(block[-1].split())
            k += 1
        out.append((n, "\n".join(before + block)))
        n = k
    return out


class Scanner:
    """Ranks templates by how much better a block compresses given them, and confirms by the words that differ."""

    def __init__(self, templates: dict[str, str] | None = None, level: int = 3):
        self.templates = TEMPLATES if templates is None else templates
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        self.given = {
            k: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            for k, t in self.templates.items()
        }
        self.words = {k: _WORD.findall(t.lower()) for k, t in self.templates.items()}
        self.notices = {k: [_WORD.findall(p.lower()) for p in re.split(r"(?<=[a-z0-9])(?<!\bv)\. ", t)] for k, t in self.templates.items()}

    def ranked(self, block: str) -> list[tuple[float, str]]:
        """(share of the compressed size that the template saves, template), best first; ties by name."""
        raw = block.lower().encode()
        alone = len(self.plain.compress(raw))
        return sorted(((1 - len(c.compress(raw)) / alone, k) for k, c in self.given.items()), key=lambda x: (-x[0], x[1]))

    def differences(self, block: str, name: str) -> tuple[list[str], list[str], float]:
        """(words of the closest sentence of the template that are missing, words in their place, share found in order)."""
        return max((d for d in self.alignments(block, name)), key=lambda d: d[2], default=([], [], 0.0))[:3]

    def alignments(self, block: str, name: str, least: float = 0.0) -> Iterator[tuple[list[str], list[str], float, list[str]]]:
        """differences() of every sentence of the template in every window of the block that may hold `least` of it, and the words put in."""
        words = _WORD.findall(block.lower())
        for notice in self.notices[name]:
            if not notice:
                continue
            known = set(notice)
            size = 2 * len(notice) + 8
            step = max(1, len(notice) // 2)
            for t in range(0, max(1, len(words) - size + step), step):
                window = words[t : t + size]
                if len(known.intersection(window)) < len(known) - (1 - least) * len(notice) - 1e-9:
                    continue
                m = difflib.SequenceMatcher(None, notice, window, autojunk=False)
                got = sum(x.size for x in m.get_matching_blocks())
                ops = m.get_opcodes()
                gone = [o for o in ops if o[0] in ("delete", "replace")]
                inside = [o for o in ops if o[0] == "insert" and 0 < o[1] < len(notice)]
                yield [w for o in gone for w in notice[o[1] : o[2]]], [w for o in gone if o[0] == "replace" for w in window[o[3] : o[4]]], got / len(notice), [w for o in inside for w in window[o[3] : o[4]]]

    def licences(self, block: str, wording: float = 0.8) -> list[tuple[str, float, float, str]]:
        """(licence, size reduction, share of the wording, differences) of all whose wording is there, the best first."""
        found = []
        for gain, name in self.ranked(block):
            best = None
            for missing, instead, share, within in self.alignments(block, name, wording):
                # a version, a clause or another licence's name in place of the template's is another licence
                if share < wording or any(_OTHER.search(w) for w in missing + instead) or any(_FAMILY.search(w) for w in within):
                    continue
                if best is None or share > best[2]:
                    best = (name, gain, share, " ".join(missing) + (" -> " + " ".join(instead) if instead else ""))
            if best:
                found.append(best)
        return sorted(found, key=lambda x: (-x[2], -x[1]))

    def scan(self, block: str, wording: float = 0.8) -> tuple[str | None, float, float, str]:
        """The first of licences(), or a null licence and the best size reduction."""
        found = self.licences(block, wording)
        if found:
            return found[0]
        order = self.ranked(block)
        return None, order[0][0] if order else 0.0, 0.0, ""


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        doc, line, block = [], [], []
        for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for n, b in blocks_of(t or ""):
                doc.append(d)
                line.append(n)
                block.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(line, pa.int64()), pa.array(block, pa.string())], names=["doc_id", "line", "block"])


def _scanned(templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in common.slices(batches):
            each = [scanner.licences(b) or [scanner.scan(b)] for b in batch.column("block").to_pylist()]
            digest = [d for d, found in zip(batch.column("digest").to_pylist(), each, strict=True) for _ in found]
            got = [g for found in each for g in found]
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.string()), *(pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.string())))], names=["digest", "license", "reduction", "wording", "differences"])

    return run


def scan_licenses(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None, salts: int = 16) -> DataFrame:
    """(doc_id, line, license, reduction, wording, differences): a row for each licence in each block of docs (doc_id, text).

    line is the block's first line with a licence-like word. A block without licences has one row: license is null where no template's wording is confirmed. Null and empty texts have no blocks; repeated rows give
    theirs each. Equal blocks are scanned once: the distinct ones are found with map-side combining, and their results
    joined back over `salts` copies, so a notice that a third of all documents carry doesn't fall to one task.
    """
    common.bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = docs.where(F.col("text").rlike(CUES.replace(r"\b", "(?<![A-Za-z0-9_])"))).mapInArrow(_blocks, "doc_id long, line long, block string")
    blocks = common.table(spark, blocks.withColumn("digest", F.sha2("block", 256)), "blocks")
    found = blocks.groupBy("digest").agg(F.first("block").alias("block")).mapInArrow(_scanned(templates), "digest string, license string, reduction double, wording double, differences string")
    found = common.table(spark, found, "licenses").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    each = blocks.drop("block").withColumn("salt", F.pmod(F.xxhash64("doc_id", "line"), F.lit(salts)).cast("int"))
    return each.join(found, ["digest", "salt"]).select("doc_id", "line", "license", "reduction", "wording", "differences")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark, common.read(spark, sf_dir, "documents"))
