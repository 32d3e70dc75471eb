"""From a parsed query to a DataFrame.

The planner asks the lexicon, by one small look-up on the driver, for the sizes of
the query's own terms, and so picks the seeds of a phrase (its rarest terms) and
leaves stop terms out of the score. Everything else is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom import storage
from termloom.operators import ranking
from termloom.operators.index import Index
from termloom.plans.query import Kind, Query, Token, parse

#: A term is a stop term if its stored postings take more bytes than this share of the corpus length.
STOP_SHARE = 0.01
#: Locators that a look-up of texts may name one by one.
NAMED = 1000


class Planner:
    def __init__(self, index: Index, *, stop_share: float = STOP_SHARE, mu: float = ranking.MU):
        self.index, self.stop_share, self.mu = index, stop_share, mu
        self._sizes: dict[str, tuple[int, int] | None] = {}
        self._holding: dict[str, DataFrame] = {}

    def sizes(self, terms: list[str]) -> dict[str, tuple[int, int]]:
        """(cf, posting bytes) of the known ones among the query's terms."""
        new = sorted({t for t in terms if t not in self._sizes})
        if new:
            rows = self.index.lexicon.where(F.col("term").isin(new)).select("term", "cf", "posting_bytes").collect()
            self._sizes |= dict.fromkeys(new) | {r["term"]: (r["cf"], r["posting_bytes"]) for r in rows}
        return {t: self._sizes[t] for t in terms if self._sizes[t] is not None}

    def _of_term(self, term: str) -> DataFrame:
        return self.index.postings.where(F.col("term") == term).select("locator", "doc_len")

    def _of_prefix(self, prefix: str) -> DataFrame:
        return self.index.postings.where(F.col("term").startswith(prefix)).select("locator", "doc_len").distinct()

    def _none(self) -> DataFrame:
        return self.index.postings.where(F.lit(False)).select("locator", "doc_len")

    def candidates(self, token: Token) -> DataFrame:
        """(locator, doc_len) of the documents that a token selects, each once."""
        if token.kind is Kind.KEYWORD:
            return self._of_term(self.index.analyzer.term(token.text))
        if token.kind is Kind.PREFIX:
            return self._of_prefix(token.text)
        if token.kind is Kind.REPLY_TO:
            if self.index.replies is None:
                return self._none()
            children = self.index.replies.where(F.col("parent_cid") == int(token.text)).select(F.col("child_locator").alias("locator")).distinct()
            return self.index.doc_stats.join(children, "locator", "left_semi")
        return self._of_phrase(token)

    def _rarest(self, token: Token) -> list[str]:
        """The known terms of a phrase, those of fewest bytes first."""
        terms = self.index.analyzer.split(token.text)
        known = self.sizes(terms)
        return sorted(known, key=lambda t: (known[t][1], t))

    def _of_phrase(self, token: Token) -> DataFrame:
        """Documents of the rarest known term (and of the second, unless it is a stop term) whose text holds the phrase.

        A phrase may begin inside a word, which positions don't tell; so texts are looked at.
        """
        by_size = self._rarest(token)
        if not by_size:
            return self._none()
        known = self.sizes(by_size)
        found = self._of_term(by_size[0])
        if len(by_size) > 1 and known[by_size[1]][1] < self.index.c * self.stop_share:
            found = found.join(self._of_term(by_size[1]).select("locator"), "locator", "left_semi")
        if token.phrase in self._holding:
            return found.join(self._holding[token.phrase], "locator", "left_semi")
        texts = self.index.comments
        if known[by_size[0]][0] <= NAMED:
            # no more documents than places: named in the scan, so that row groups and pages of other texts are skipped
            texts = texts.where(F.col("locator").isin([r["locator"] for r in found.select("locator").collect()]))
        holding = texts.where(F.contains(F.lower("text"), F.lit(token.phrase))).select("locator")
        return found.join(holding, "locator", "left_semi")

    def selected(self, query: Query) -> DataFrame:
        """(locator, doc_len): any branch, of each branch all operands and none of the negated ones."""
        branches = []
        for branch in query.branches:
            positive = [self.candidates(t) for t in branch if not t.negated]
            found = reduce(lambda a, b: a.join(b.select("locator"), "locator", "left_semi"), positive)
            for t in branch:
                if t.negated:
                    found = found.join(self.candidates(t).select("locator"), "locator", "left_anti")
            branches.append(found)
        if len(branches) == 1:
            return branches[0]
        return reduce(lambda a, b: a.unionByName(b), branches).distinct()

    def scored(self, query: Query) -> DataFrame:
        """(locator, score) of a free text query."""
        terms = [self.index.analyzer.term(w) for w in query.words]
        scoring = ranking.scored_terms(terms, self.sizes(terms), self.index.c, self.stop_share)
        tokens = [b[0] for b in query.branches]
        if scoring and all(t.kind is Kind.KEYWORD for t in tokens) and {s.term for s in scoring} == set(terms) & {self.index.analyzer.term(t.text) for t in tokens}:
            # candidates are the very documents that hold scored terms: one pass over their postings
            rows = ranking.frequencies(self.index.postings, scoring)
            return rows.select("locator", ranking.likelihood(scoring, self.index.c, self.mu).alias("score"))
        return ranking.rank(self.selected(query), self.index.postings, scoring, self.index.c, self.mu)

    def search(self, query: str, top_k: int | None = None) -> DataFrame:
        """A free text gives (cid, locator, score), best first; a boolean query (cid, locator) by locator, whatever ``top_k``."""
        parsed = parse(query)
        cids = self.index.comments.select("locator", "cid")
        if parsed.boolean:
            return self.selected(parsed).select("locator").join(cids, "locator").select("cid", "locator").orderBy("locator")
        best = ranking.top(self.scored(parsed), top_k)
        return best.join(cids, "locator").select("cid", "locator", "score").orderBy(F.desc("score"), F.desc("locator"))

    def texts(self, found: DataFrame) -> DataFrame:
        """``found`` with its texts, which are read for these rows only."""
        return found.join(self.index.comments.select("locator", "text"), "locator")

    def _for_batch(self, queries: list[Query]) -> Planner:
        """A planner over the postings of the queries' own terms, with what texts hold their phrases.

        Postings are read once and texts once, however many queries there are; phrases of rare terms name their texts.
        """
        tokens = {t for query in queries for branch in query.branches for t in branch}
        words = {w for query in queries for w in query.words}
        phrases = {t for t in tokens if t.kind in (Kind.PHRASE, Kind.PHRASE_PREFIX)}
        analyzer = self.index.analyzer
        terms = {analyzer.term(w) for w in words} | {analyzer.term(t.text) for t in tokens if t.kind is Kind.KEYWORD} | {w for t in phrases for w in analyzer.split(t.text)}
        self.sizes(sorted(terms))
        prefixes = sorted({t.text for t in tokens if t.kind is Kind.PREFIX})
        wanted = reduce(or_, (F.col("term").startswith(p) for p in prefixes), F.col("term").isin(sorted(terms)))
        postings = storage.stored(self.index.postings.where(wanted).select("term", "locator", "doc_len", "tf"))
        planner = Planner(replace(self.index, postings=postings), stop_share=self.stop_share, mu=self.mu)
        planner._sizes = self._sizes
        frequent = sorted({t.phrase for t in phrases if (rarest := self._rarest(t)) and self._sizes[rarest[0]][0] > NAMED})
        if frequent:
            text = F.lower("text")
            held = F.array(*(F.when(F.contains(text, F.lit(p)), F.lit(i)) for i, p in enumerate(frequent)))
            found = storage.stored(self.index.comments.select("locator", F.explode(F.array_compact(held)).alias("phrase")))
            planner._holding = {p: found.where(F.col("phrase") == i).select("locator") for i, p in enumerate(frequent)}
        return planner

    def search_batch(self, queries: list[tuple[int, str]], top_k: int) -> DataFrame:
        """(query_id, rank, cid, locator, score) of many queries in one job; boolean results score 0."""
        parts = []
        parsed_queries = [parse(text) for _, text in queries]
        planner = self._for_batch(parsed_queries)
        for (query_id, _), parsed in zip(queries, parsed_queries):
            rows = planner.selected(parsed).select("locator", F.lit(0.0).alias("score")) if parsed.boolean else planner.scored(parsed)
            parts.append(rows.select(F.lit(query_id).cast("long").alias("query_id"), "locator", "score"))
        best = ranking.top_each(reduce(lambda a, b: a.unionByName(b), parts), top_k)
        return best.join(self.index.comments.select("locator", "cid"), "locator").select("query_id", "rank", "cid", "locator", "score")
