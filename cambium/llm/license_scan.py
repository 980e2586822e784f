"""Licence notices found by their rarest words, the distances between those, and their mandatory phrases."""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, once A-Z is lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A notice: its label, its words, and the phrases that must stand in it (all of its words where none is given)."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def mandatory(self) -> list[tuple[int, list[str]]]:
        """Every mandatory phrase as (place of its first word in the template, words)."""
        found = []
        for phrase in self.phrases or (self.text,):
            wanted = phrase.split()
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(wanted)] == wanted)
            found.append((at, wanted))
        return found


#: The phrases whose places are counted, with their labels.
BASE = (
    Template("cc-by", "cc by"),
    Template("gpl", "general public license"),
    Template("reserved", "all rights reserved"),
)

#: Wording of public licences and of the notices that name them.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        ("you may not use this file except in compliance with the license", "www apache org licenses"),
    ),
    Template("mit", "released under the mit license", ("the mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "provided that the following conditions are met"),
    ),
    Template("gpl-2.0", "gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3.0", "gnu general public license version 3", ("general public license version 3",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("mpl-2.0", "mozilla public license version 2 0"),
    Template("epl-2.0", "eclipse public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    Template("cc0", "cc0 1 0 universal"),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    Template("cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("cc-by", "creative commons attribution"),
    Template("apache-2.0", "spdx license identifier apache 2 0"),
    Template("bsd", "spdx license identifier bsd"),
    Template("gpl", "spdx license identifier gpl"),
    Template("mit", "spdx license identifier mit"),
)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does just that where all characters are ASCII, in less time."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def licence_word_counts(docs: DataFrame, templates: Sequence[Template], *, text_col: str = "text") -> dict[str, int]:
    """In how many documents each word of the templates stands; summed in the tasks, so that at most a row per word and task moves."""
    vocabulary = sorted({w for t in templates for w in t.words})
    words = docs.select(words_of(F.col(f"`{text_col}`")).alias("words"))
    held = words.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))).alias("word"))
    counted = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: counted.get(w, 0) for w in vocabulary}


def anchors(template: Template, documents: dict[str, int]) -> list[int]:
    """Places of the words by which a template is looked up: the one of highest inverse document frequency of each mandatory phrase.

    A template of a single phrase gets its second such word too, so that there is a distance to compare. Whatever holds the
    phrases holds these words at these distances, so looking up no others loses nothing.
    """
    phrases = template.mandatory()
    places = []
    for at, words in phrases:
        ranked = sorted(range(len(words)), key=lambda i: (documents[words[i]], i))
        places += [at + i for i in ranked[: 2 if len(phrases) == 1 else 1]]
    return sorted(set(places))


def license_scan(
    docs: DataFrame, *, base: Sequence[Template] = BASE, notices: Sequence[Template] = NOTICES, text_col: str = "text", documents: dict[str, int] | None = None
) -> DataFrame:
    """The columns of ``docs`` plus ``licences``: what of the templates stands in each text.

    1. One pass counts the documents that hold each word of the templates (``documents``, where it is given, is that count).
    2. The positional index lists for each anchor (`anchors`) its templates and places; the templates bound its size.
    3. Every word of a text that is an anchor gives, for each of its postings, where the template would begin. Sorted, the
       beginnings on which all anchors of a template agree are candidates: an intersection of postings by relative position.
    4. A candidate counts where every mandatory phrase stands in full at its place.

    All steps are column expressions over one row, so texts are not shuffled and a row of any kind costs what its own text does.

    ``licences``: n_words; n_base, the places of base templates; first_word and last_word, the least and largest of them (words
    from 0; null without any); base_labels; labels, those of notices too (both distinct, sorted, comma-joined, empty without any);
    score, the largest share of a template's words that stand in their place, 0 without any; found, all places as (template,
    label, word, share). A notice may begin before the text does if its phrases do not, so ``word`` can be negative.

    A null text is empty. Repeated rows are scanned one by one. An empty table gives an empty result.
    """
    templates = [*base, *notices]
    documents = licence_word_counts(docs, templates, text_col=text_col) if documents is None else documents
    index: dict[str, list[tuple[int, int]]] = {}
    needed = []
    for number, template in enumerate(templates):
        places = anchors(template, documents)
        needed.append(len(places))
        for place in places:
            index.setdefault(template.words[place], []).append((number, place))
    posting = lambda number, place: F.struct(F.lit(number).alias("template"), F.lit(place).alias("place"))
    lists = F.create_map(*[x for w, held in sorted(index.items()) for x in (F.lit(w), F.array(*[posting(*p) for p in held]))])
    literal = lambda words: F.array(*[F.lit(w) for w in words])
    texts = F.array(*[literal(t.words) for t in templates])
    phrases = F.array(*[F.array(*[F.struct(F.lit(at).alias("place"), literal(words).alias("words")) for at, words in t.mandatory()]) for t in templates])
    labels = F.array(*[F.lit(t.label) for t in templates])
    need = F.array(*[F.lit(n) for n in needed])

    own = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own, strict=True)])
    rows = rows.withColumn("words", words_of(F.col(own[docs.columns.index(text_col)])))
    hit = lambda w, i: F.when(w.isin(sorted(index)), F.struct(w.alias("word"), i.alias("at")))
    rows = rows.withColumn("hits", F.array_compact(F.transform("words", hit)))
    begin = lambda h: F.transform(lists[h.word], lambda p: F.struct(p.template.alias("template"), (h["at"] - p.place).alias("at"), p.place.alias("place")))
    rows = rows.withColumn("begins", F.array_sort(F.flatten(F.transform("hits", begin))))

    def agreed(x: Column, i: Column) -> Column:
        last = F.get("begins", i + F.get(need, x.template) - 1)
        return F.when((last.template == x.template) & (last["at"] == x["at"]), F.struct(x.template.alias("template"), x["at"].alias("at")))

    def verified(x: Column) -> Column:
        def stands(p: Column) -> Column:
            at = x["at"] + p.place
            return F.when(at >= 0, F.slice("words", F.greatest(at, F.lit(0)) + 1, F.size(p.words)) == p.words).otherwise(False)

        return F.forall(F.get(phrases, x.template), stands)

    def described(x: Column) -> Column:
        words, first = F.get(texts, x.template), F.greatest(-x["at"], F.lit(0))
        here = F.slice("words", x["at"] + first + 1, F.size(words) - first)
        same = F.filter(F.zip_with(here, F.slice(words, first + 1, F.size(words)), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda s: s)
        return F.struct(
            x.template.alias("template"), F.get(labels, x.template).alias("label"), x["at"].cast("long").alias("word"), (F.size(same) / F.size(words)).alias("share")
        )

    rows = rows.withColumn("agreed", F.array_compact(F.transform("begins", agreed)))
    rows = rows.withColumn("found", F.transform(F.filter("agreed", verified), described))
    of_base = F.filter("found", lambda x: x.template < len(base))
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x.label))), ",")
    licences = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.size(of_base).cast("long").alias("n_base"),
        F.array_min(F.transform(of_base, lambda x: x.word)).alias("first_word"),
        F.array_max(F.transform(of_base, lambda x: x.word)).alias("last_word"),
        joined(of_base).alias("base_labels"),
        joined("found").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x.share)), F.lit(0.0)).alias("score"),
        F.col("found").alias("found"),
    )
    return rows.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, own, strict=True)], licences.alias("licences"))
