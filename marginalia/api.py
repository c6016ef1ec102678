"""A session facade: notes, search, review and routing over tables.

A :class:`Vault` holds immutable tables. Reading calls return DataFrames;
changing calls write the new state to a table of its own and return a new vault.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import control, dynamics, gate, index, labels, pairs, rank, recall, routing, sections, store
from .plans.tables import settle

NOTE = "key string, title string, zone string, type string, labels array<string>, links array<string>, updated string, polarity string, expires_at string, body string, size long, version long"
LOG = "key string, zone string, ts timestamp"
ROUTE = "seq int, trigger string, document string"


@dataclass(frozen=True)
class Vault:
    """Notes (``NOTE``), an access log (``LOG``) and routes (``ROUTE``)."""

    notes: DataFrame
    log: DataFrame
    routes: DataFrame
    exact: bool = True
    #: The stored index of ``documents()``, made at the first search and refreshed by what a change touches.
    held: tuple[store.Index, ...] = ()

    @classmethod
    def empty(cls, spark: SparkSession) -> Vault:
        return cls(spark.createDataFrame([], NOTE), spark.createDataFrame([], LOG), spark.createDataFrame([], ROUTE))

    @property
    def spark(self) -> SparkSession:
        return self.notes.sparkSession

    # -- reading -------------------------------------------------------------

    def documents(self) -> DataFrame:
        return self.notes.select(F.col("key").alias("doc_id"), F.concat_ws(" ", "title", "body").alias("text"))

    def index(self) -> store.Index:
        """The stored index of all notes."""
        if not self.held:
            object.__setattr__(self, "held", (store.build(self.documents(), self.exact),))
        return self.held[0]

    def _with(self, notes: DataFrame) -> Vault:
        """The vault with other notes; its index, if it has one, takes in those that differ."""
        made = replace(self, notes=settle(notes, "notes"), held=())
        if self.held:
            seen = self.documents().select("doc_id", F.sha2("text", 256).alias("digest"))
            changed = settle(store.changes(made.documents(), seen), "changed-notes")
            object.__setattr__(made, "held", (store.refresh(self.held[0], changed, self.exact) if changed.limit(1).count() else self.held[0],))
        return made

    def _triggers(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Postings, lengths and statistics of the routes' triggers, each computed once."""
        docs = self.routes.select(F.col("seq").cast("long").alias("doc_id"), F.col("trigger").alias("text"))
        post = settle(index.postings(docs, exact=self.exact), "postings")
        lengths = settle(index.doc_lengths(post), "lengths")
        return post, lengths, settle(index.corpus_stats(docs, lengths), "stats")

    def visible(self, today: str, zone: str | None = None, include_archive: bool = False) -> DataFrame:
        """Notes that a search may return."""
        own = self.notes.where(~index.expired(F.col("expires_at"), F.lit(today).cast("date")))
        if zone is not None and zone.strip().lower() == "_archive":
            return own.where(index.archived(F.col("zone")))
        if zone is not None:
            return own.where(F.col("zone").isin(zone, "" if zone.strip().lower() in ("", "inbox") else zone.strip(), zone.strip().lower()))
        return own if include_archive else own.where(~index.archived(F.col("zone")))

    def strength(self, now: str) -> DataFrame:
        """(doc_id, eff) of notes with accesses."""
        folded = dynamics.fold_accesses(self.log)
        return folded.select(F.col("key").alias("doc_id"), dynamics.effective(F.col("strength"), F.col("stability"), F.col("last_access"), F.lit(now).cast("timestamp")).alias("eff"))

    def priority(self, today: str) -> DataFrame:
        return dynamics.zone_priority(dynamics.zone_ema(self.log, F.lit(today).cast("date")))

    def search(self, query: str, now: str, limit: int = 8, zone: str | None = None, include_archive: bool = False, wanted: list[str] | None = None, expansions: dict[str, str] | None = None) -> DataFrame:
        """Ranked hits with snippets: labels filter before the cut, visibility after it."""
        today, own = now[:10], self.index()
        post, lengths, stats = own.post, own.lengths, own.stats
        asked = self.spark.createDataFrame([(0, query)], "query_id int, text string")
        terms = rank.query_terms(asked, self.exact)
        terms = settle(terms, "terms")
        scores = settle(rank.bm25(terms, post, lengths, stats), "scores")
        if expansions:
            wide = self.spark.createDataFrame([(0, k, v) for k, v in expansions.items()], "query_id int, tier string, text string")
            added = rank.bm25(rank.expansion_terms(wide, terms, self.exact), post, lengths, stats, script_bonus=False)
            scores = settle(rank.expanded(scores, added, rank.covering(terms, post)), "scores")
        if wanted:
            have = self.notes.where(labels.has_all(F.col("labels"), F.array(*map(F.lit, wanted))))
            scores = scores.join(have.select(F.col("key").alias("doc_id")), "doc_id", "left_semi")
        cut = settle(rank.top_k(scores, rank.CANDIDATES).drop("rank"), "candidates")
        seen = self.visible(today, zone, include_archive)
        kept = cut.join(seen.select(F.col("key").alias("doc_id")), "doc_id", "left_semi")
        lifted = rank.boosted(kept, self.strength(now), self.notes.select(F.col("key").alias("doc_id"), "zone"), self.priority(today))
        best = settle(rank.top_k(lifted, limit), "hits")
        shown = best.join(self.notes, best["doc_id"] == self.notes["key"]).withColumn("text", F.col("body")).crossJoin(asked.select(T.tokens(F.col("text"), self.exact).alias("terms")))
        out = recall.snippets(shown).select("rank", "key", "title", "zone", "type", "labels", F.slice("links", 1, 3).alias("related"), "polarity", "score", "snippet", "updated")
        return out.orderBy("rank")

    def get(self, name: str) -> DataFrame:
        """The note that ``name`` resolves to by key, slug or alias."""
        keyed = self.notes.withColumn("mtime", F.col("updated"))
        found = index.resolve(self.spark.createDataFrame([(name,)], "name string"), keyed).where("key is not null")
        return self.notes.join(found.select("key"), "key", "left_semi")

    def listing(self, zone: str | None = None, wanted: list[str] | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        own = self.notes if zone is None else self.notes.where(F.col("zone") == zone)
        if wanted:
            own = own.where(labels.has_all(F.col("labels"), F.array(*map(F.lit, wanted))))
        return index.listing(own.select("key", "title", "zone", "type", "labels", "updated"), offset, limit)

    def label_counts(self) -> DataFrame:
        return labels.histogram(self.notes)

    def related(self, limit: int = 5) -> DataFrame:
        """Neighbours of every note that it doesn't link yet."""
        own = self.index()
        post, lengths, stats = own.post, own.lengths, own.stats
        linked = self.notes.select(F.col("key").alias("src"), F.explode("links").alias("t")).select("src", T.slug(F.col("t")).alias("dst"))
        return settle(rank.related(post, lengths, stats, linked, limit), "related")

    def catalog(self, now: str) -> DataFrame:
        """(key, zone, stale, related) of active notes, for a curation plan."""
        active = self.notes.where(~index.archived(F.col("zone")))
        near = self.related(4).groupBy(F.col("query_id").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("related"))
        state = dynamics.fold_accesses(self.log)
        old = dynamics.stale(active.join(state, "key"), F.lit(now).cast("timestamp")).select("key", F.lit(True).alias("stale"))
        return active.join(near, "key", "left").join(old, "key", "left").select("key", "title", "zone", F.coalesce("stale", F.lit(False)).alias("stale"), F.coalesce("related", F.array().cast("array<string>")).alias("related"))

    def questions(self, limit: int = 20) -> DataFrame:
        """Pairs worth a review, the most alike first."""
        active = self.notes.where(~index.archived(F.col("zone"))).select("key", "body")
        found = pairs.similar_pairs(pairs.token_sets(active, "key", "body", self.exact))
        return found.orderBy(F.col("similarity").desc(), "a", "b").limit(limit)

    def capacity(self, max_protected: int = 1000, max_bytes: int = 100 << 20) -> DataFrame:
        return gate.capacity_report(self.notes, max_protected, max_bytes)

    def digest(self, now: str, limit: int = 10) -> DataFrame:
        rows = self.visible(now[:10]).join(self.strength(now), F.col("key") == F.col("doc_id"), "left").select("key", "zone", F.coalesce("eff", F.lit(1.0)).alias("eff"), "updated")
        return gate.digest(rows, self.priority(now[:10]), limit)

    def sections(self) -> DataFrame:
        return sections.sections(self.notes, "key", "body")

    def open(self, query: str, limit: int = 3) -> DataFrame:
        """Documents by their best triggers."""
        post, lengths, stats = self._triggers()
        asked = rank.query_terms(self.spark.createDataFrame([(0, query)], "query_id int, text string"), self.exact)
        ranked = rank.top_k(rank.bm25(asked, post, lengths, stats), 100).join(self.routes, F.col("doc_id") == F.col("seq"))
        return routing.open_documents(ranked.select("query_id", "rank", "document"), limit)

    def match(self, task: str) -> DataFrame:
        return routing.match(self.routes, self.spark.createDataFrame([(0, task)], "task_id int, task string"))

    def check(self) -> DataFrame:
        return routing.integrity(self.routes, self.notes.select(F.concat("key", F.lit(".md")).alias("document")))

    # -- changing --------------------------------------------------------------

    def remember(self, title: str, body: str, updated: str, zone: str | None = None, kind: str = "topic", note_labels: list[str] | None = None, links: list[str] | None = None, expected: int | None = None) -> Vault:
        """The vault with one note written; a wrong expected version is an error."""
        # Fixed value: the zone of each type.
        place = {"person": "people", "project": "projects", "preference": "identity", "fact": "knowledge", "topic": "knowledge", "session": "journal"}
        row = self.spark.createDataFrame([(title, zone if zone is not None else place.get(kind, ""), kind, note_labels or [], links or [], updated, body)], "title string, zone string, type string, labels array<string>, links array<string>, updated string, body string")
        write = settle(row.select(
            T.slug(F.col("title")).alias("key"), "title", index.normal_zone(F.col("zone")).alias("zone"), "type", labels.normalize(F.col("labels")).alias("labels"), "links", "updated",
            F.lit("positive").alias("polarity"), F.lit(None).cast("string").alias("expires_at"), "body", F.octet_length("body").cast("long").alias("size"), F.lit(0).cast("long").alias("version"), F.lit(expected).cast("long").alias("expected"),
        ), "write")
        if write.where("zone is null or labels is null").limit(1).count():
            raise ValueError("invalid zone or label")
        notes, refused = control.upsert_versioned(self.notes, write)
        if refused.limit(1).count():
            raise ValueError("the note has another version")
        return self._with(notes)

    def accessed(self, key: str, ts: str) -> Vault:
        """The vault with one access logged; an unknown key changes nothing."""
        row = self.notes.where(F.col("key") == key).select("key", "zone", F.lit(ts).cast("timestamp").alias("ts"))
        return replace(self, log=settle(self.log.unionByName(row), "log"))

    def curate(self, answer: str, now: str) -> tuple[Vault, DataFrame]:
        """The vault after the accepted part of a plan, and every operation with its reason.

        Notes that the plan moves are linked to mates of their new zone.
        """
        plan = control.extract_plans(self.spark.createDataFrame([(answer,)], "text string")).drop("reason")
        strength = self.strength(now).select(F.col("doc_id").alias("key"), "eff")
        judged = settle(gate.validate(plan, self.notes, strength), "judged")
        accepted = judged.where("reason is null")
        moves = accepted.where("op = 'rezone'").select(F.col("slug").alias("key"), "zone")
        gone = accepted.where("op = 'supersede'").select(F.explode(F.array("stale", "by")).alias("key"))
        target = T.slug(F.col("t"))
        linked = self.notes.select("key", F.explode("links").alias("t")).select(F.least("key", target).alias("a"), F.greatest("key", target).alias("b"))
        asked = accepted.where("op = 'link'").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        dense = gate.dense_links(moves, self.notes, linked.unionByName(asked), gone)
        none = {c: F.lit(None).cast("string") for c in ("slug", "zone", "stale", "by", "reason")}
        extra = dense.select("a", "b").withColumns({"seq": F.lit(-1), "op": F.lit("link"), **none}).select(*judged.columns)
        notes = control.apply_plan(self.notes.select("key", "title", "zone", "links", "body"), accepted.unionByName(extra))
        rest = self.notes.drop("title", "zone", "links", "body")
        return self._with(rest.join(notes, "key").select(*self.notes.columns)), judged

    def forget(self, key: str, now: str) -> tuple[Vault, DataFrame]:
        return self.curate(json.dumps({"ops": [{"op": "archive", "slug": key}]}), now)

    def register(self, trigger: str, document: str) -> Vault:
        return replace(self, routes=settle(routing.register(self.routes, self.spark.createDataFrame([(0, trigger, document)], ROUTE)), "routes"))
