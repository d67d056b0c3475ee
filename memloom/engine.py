"""One object over a log: verbs that append events, and views that read them.

Every verb takes a set of rows; a single call is a set of one.  Reads are lazy
tables; a verb that would change the log on reading returns its events for the
caller to append."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.namespaces import normalise
from .operators import gates, governance, graph, lifecycle, search, semantic, vector
from .plans import fold, writing
from .plans.iterate import checkpointed
from .policies import Assembly, Conflict, Dedup, Firewall, Links, Retention, Retrieval, Scoring, Sessions
from .schema import MEMORY_TYPES
from .sources import log, tables


class Engine:
    """``path``: the log's folder.  ``embed``: text column to vector column."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "full", embed=vector.hash_embed, retrieval: Retrieval = Retrieval(), firewall: Firewall = Firewall(), retention: Retention = Retention(), dedup: Dedup = Dedup(), conflict: Conflict = Conflict(), evolve: Links | None = None):
        self.spark, self.path, self.mode, self.embed = spark, path, mode, embed
        self.retrieval, self.firewall, self.retention = retrieval, firewall, retention
        self.dedup, self.conflict, self.evolve = dedup, conflict, evolve

    # --- projections

    def events(self, after: int = 0) -> DataFrame:
        if not log._exists(self.spark, self.path):
            from .schema import EVENT

            return self.spark.createDataFrame([], EVENT)
        return log.read(self.spark, self.path, after)

    def records(self) -> DataFrame:
        return fold.fold_records(self.events())

    def vectors(self) -> DataFrame:
        return fold.fold_vectors(self.events(), self.embed)

    def edges(self) -> DataFrame:
        return fold.fold_graph(self.events())[1]

    def rebuild(self) -> DataFrame:
        return fold.rebuild(self.events(), self.mode)

    def describe(self) -> DataFrame:
        return self.records().groupBy("namespace", "memory_type", "status").count()

    # --- the write door

    def append(self, events: DataFrame) -> int:
        return log.append(self.spark, self.path, events, self.mode)

    def _events(self, rows: DataFrame, kind: str, now: datetime, actor: str = "engine", namespace: Column | None = None, **payload: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), (namespace if namespace is not None else F.col("namespace")).alias("namespace"), F.lit(actor).alias("actor"), F.lit(now).cast("timestamp").alias("ts"), tables.payload(**payload).alias("payload"))

    def _write(self, rows: DataFrame, now: datetime, **more: Column) -> int:
        record = F.struct(*[F.col(c) for c in self._record_columns()])
        return self.append(self._events(rows, "memory.write", now, record=record, **more))

    @staticmethod
    def _record_columns() -> list[str]:
        from .schema import RECORD

        return [f.name for f in RECORD]

    def write(self, rows: DataFrame, now: datetime, memory_type: str = "episodic") -> int:
        """``rows``: record_id, namespace, content; optional role, channel, entity, attribute, valid_from, tags.
        Each is judged by the firewall and stored, quarantined ones too; returns the log's last number."""
        if memory_type == "shared":
            raise ValueError("records of type shared are made by grants")
        if memory_type not in MEMORY_TYPES:
            raise ValueError(f"memory_type must be one of {MEMORY_TYPES}")
        have = set(rows.columns)
        col = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
        values = dict(record_id=F.col("record_id"), namespace=F.col("namespace"), memory_type=F.lit(memory_type), content=F.col("content"), entity=semantic_entity(col("entity")), attribute=col("attribute"), valid_from=F.coalesce(col("valid_from", "timestamp"), F.lit(now).cast("timestamp")), recorded_at=F.lit(now).cast("timestamp"), source=tables.source(F.coalesce(col("role"), F.lit("user")), F.coalesce(col("channel"), F.lit("internal")), col("doc_path"), col("message_id")), consent_tags=col("consent_tags", "array<string>"), pii_tier=F.coalesce(col("pii_tier"), F.lit("none")), tags=col("tags", "array<string>"), group_id=col("group_id"))
        return self._store(rows.select(*tables.record(**values)), now)

    def _store(self, rows: DataFrame, now: datetime) -> int:
        """Whole records through the firewall, semantic ones through merging and the ladder, and into the log;
        then what they corroborate is lifted and, where the engine evolves, they are linked."""
        at = F.lit(now).cast("timestamp")
        rows = checkpointed(rows)
        homes = rows.select("namespace").distinct()
        # folded once, and only what lies beside the batch
        old = checkpointed(self.records().join(homes, "namespace", "left_semi").select(*self._record_columns()))
        base = rows.withColumns({"role": F.col("source.role"), "channel": F.col("source.channel"), "__at": at})
        odd = governance.prefix_bridges(self._with_recent(base, old), self.firewall).where("bridge").select("record_id")
        if not old.groupBy("namespace").count().where(F.col("count") >= self.firewall.min_neighbours).isEmpty():
            near = vector.topk(rows.select(F.col("record_id").alias("query_id"), "namespace", self.embed(F.col("content")).alias("vector")), self.vectors(), self.firewall.min_neighbours)
            near = near.join(old.select("record_id", "quarantined"), "record_id")
            odd = odd.unionByName(governance.outliers(near, self.firewall).where("outlier").select(F.col("query_id").alias("record_id"))).distinct()
        odd = odd.withColumn("anomalous", F.lit(True))
        base = checkpointed(governance.stamped(base.drop("trust", "instruction_flag", "quarantined", "status").join(odd, "record_id", "left"), self.firewall).select(*self._record_columns()))
        kinds = [r[0] for r in base.select("memory_type").distinct().collect()]  # one of the nine types
        if "semantic" in kinds:
            after = self._write_semantic(base.where("memory_type = 'semantic'"), old, now)
            if len(kinds) > 1:
                after = self._write(base.where("memory_type <> 'semantic'"), now)
        else:
            after = self._write(base, now)
        clean = base.where(~F.col("quarantined"))
        if not old.unionByName(base).where("quarantined and status <> 'deleted'").isEmpty():
            after = max(after, self.corroborate(clean, now))
        if self.evolve is not None:
            after = max(after, self.link_new(clean, now, self.evolve))
        return after

    def _write_semantic(self, rows: DataFrame, old: DataFrame, now: datetime) -> int:
        at = F.lit(now).cast("timestamp")
        done = writing.semantic_writes(rows, old, at, self.embed, self.dedup, self.conflict)
        record = F.struct(*[F.col(c) for c in self._record_columns()])
        text = lambda c: c.cast("string")
        closing = F.create_map(F.lit("status"), F.lit("archived"), F.lit("valid_to"), text(F.col("valid_to")), F.lit("superseded_at"), text(at), F.lit("evolve_to"), F.col("evolve_to"))
        merges = done["merges"].withColumn("namespace", F.col("record.namespace"))
        parts = [
            self._events(done["kept"], "memory.write", now, record=record),
            self._events(merges, "memory.merge", now, kept_record_id=F.col("kept_record_id"), dropped_record_id=F.col("record.record_id"), record=F.col("record")),
            self._events(done["closed"], "memory.decay_transition", now, record_id=F.col("record_id"), transition=F.lit("superseded"), set=closing),
            self._events(done["stored"], "memory.write", now, record=record),
            self._events(done["conflicts"], "memory.conflict", now, **{c: F.col(c) for c in ("entity", "attribute", "verdict", "action", "incoming_record_id", "existing_record_id")}),
        ]
        events = parts[0].withColumn("batch_pos", F.lit(0))
        for k, part in enumerate(parts[1:], 1):
            events = events.unionByName(part.withColumn("batch_pos", F.lit(k)))
        return self.append(events)

    def corroborate(self, incoming: DataFrame, now: datetime) -> int:
        """Counts the votes of records that came in for quarantined ones, and lifts those with enough: a
        fact that another holds by now ends in it, a skill goes by its stage, all else becomes active."""
        records = self.records()
        slim = lambda d: d.select("record_id", "namespace", "memory_type", "entity", "attribute", "content_fingerprint", F.col("source.role").alias("role"), F.col("source.channel").alias("channel"), "trust", "corroborations")
        held = records.where(F.col("quarantined") & (F.col("status") != "deleted"))
        votes = checkpointed(governance.corroborated(slim(held), slim(incoming), self.firewall).join(held.select("record_id", "namespace", "memory_type", "entity", "attribute", "skill_stage", "valid_from"), "record_id"))
        if votes.isEmpty():
            return 0
        active = semantic.active_facts(records).select("namespace", "entity", "attribute", F.col("record_id").alias("holder"), F.col("valid_from").alias("holder_from"))
        v = votes.join(active, ["namespace", "entity", "attribute"], "left")
        beaten = (F.col("memory_type") == "semantic") & F.col("holder").isNotNull()
        status = F.when(beaten, "archived").when(F.col("memory_type") == "procedural", lifecycle.skill_status(F.col("skill_stage"))).otherwise("activated")
        count = F.create_map(F.lit("corroborations"), F.col("votes").cast("string"))
        lift = F.create_map(F.lit("quarantined"), F.lit("false"), F.lit("status"), status)
        end = F.when(beaten, F.create_map(F.lit("evolve_to"), F.col("holder"), F.lit("valid_to"), F.greatest("valid_from", "holder_from").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
        change = F.when(F.col("lifted"), F.map_concat(count, lift, end)).otherwise(count)
        return self.append(self._events(v, "memory.decay_transition", now, record_id=F.col("record_id"), transition=F.when(F.col("lifted"), "lift").otherwise("corroborate"), set=change))

    def link_new(self, rows: DataFrame, now: datetime, policy: Links = Links()) -> int:
        """Links records that were just written to their nearest neighbours."""
        q = rows.select(F.col("record_id").alias("query_id"), "namespace", self.embed(F.col("content")).alias("vector"))
        live = self.records().where(gates.retrievable()).select("record_id")
        hits = vector.topk(q, self.vectors().join(live, "record_id", "left_semi"), policy.auto_links + policy.budget + 1)
        links = graph.auto_links(hits, self.edges(), policy).join(rows.select(F.col("record_id").alias("src"), "namespace"), "src")
        return self.append(self._events(links, "memory.link", now, src=F.col("src"), dst=F.col("dst"), rel=F.col("rel"), weight=F.col("weight"), reason=F.lit("auto")))

    @staticmethod
    def _with_recent(rows: DataFrame, old: DataFrame) -> DataFrame:
        old = old.select("record_id", "namespace", "content", "recorded_at", "quarantined")
        new = rows.select("record_id", "namespace", "content", F.col("__at").alias("recorded_at"), F.lit(False).alias("quarantined"))
        return old.unionByName(new)

    def write_messages(self, conversations: DataFrame, now: datetime) -> int:
        """One record a turn (conv_id, turn, role, text)."""
        if not conversations.where("role is null").limit(1).isEmpty():
            raise ValueError("a turn without a role")
        return self._store(tables.transcript(conversations), now)

    def write_episode(self, conversations: DataFrame, now: datetime) -> int:
        """One record a conversation, grouped by its content's fingerprint."""
        e = tables.episodes(conversations)
        at = F.lit(now).cast("timestamp")
        return self._store(e.select(*tables.record(record_id=F.concat(F.lit("ep-"), F.substring("group_id", 1, 16)), namespace=F.concat(F.lit("conv/"), "conv_id"), memory_type=F.lit("episodic"), content=F.col("content"), group_id=F.col("group_id"), valid_from=at, recorded_at=at, source=tables.source(F.lit("user"), F.lit("messages"), message_id=F.col("group_id")))), now)

    def set_persona(self, namespace: str, text: str, now: datetime) -> int:
        """Replaces the namespace's persona; the old text goes into its history."""
        ns = normalise(namespace)
        rid = f"persona:{ns}"
        old = self.records().where(F.col("record_id") == rid)
        at = F.lit(now).cast("timestamp")
        one = self.spark.range(1).select(F.lit(rid).alias("rid"))
        prior = old.select(F.col("record_id").alias("rid"), F.col("version").alias("v"), F.array_append(F.coalesce("history", F.array().cast(old.schema["history"].dataType)), F.struct("version", "content", "valid_from", at.alias("valid_to"))).alias("h"))
        rows = one.join(prior, "rid", "left").select(*tables.record(record_id=F.lit(rid), namespace=F.lit(ns), memory_type=F.lit("working"), content=F.lit(text), valid_from=at, recorded_at=at, version=F.coalesce(F.col("v") + 1, F.lit(1)), history=F.col("h"), importance=F.lit(1.0), trust=F.lit(0.9), source=tables.source(F.lit("operator"), F.lit("persona"))))
        return self._write(rows, now)

    def ingest(self, docs: DataFrame, namespace: str, now: datetime) -> int:
        """Documents (doc_path, text) as chunks that are not stored yet."""
        ns = normalise(namespace)
        found = lifecycle.chunks(docs.select("doc_path", "text")).withColumn("content_fingerprint", F.sha2("chunk", 256))
        stored = self.records().where((F.col("memory_type") == "resource") & (F.col("namespace") == ns)).select(F.col("source.doc_path").alias("doc_path"), "content_fingerprint")
        new = lifecycle.fresh_chunks(found, stored).dropDuplicates(["doc_path", "content_fingerprint"])
        rows = new.select(F.concat(F.lit("r-"), F.substring(F.sha2(F.concat_ws("#", F.lit(ns), "doc_path", "content_fingerprint"), 256), 1, 24)).alias("record_id"), F.lit(ns).alias("namespace"), F.col("chunk").alias("content"), F.lit("tool").alias("role"), F.lit("ingest").alias("channel"), "doc_path", F.concat(F.lit("chunk:"), "chunk_no").alias("message_id"))
        return self.write(rows, now, "resource")

    # --- reads

    def retrieve(self, namespace: str, memory_type: str | None = None, group: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
        return gates.listed(self.records(), normalise(namespace), memory_type, group, tags)

    def search(self, queries: DataFrame, now: datetime, scoring: Scoring = Scoring(), **options) -> DataFrame:
        """``queries``: query_id, namespace, text; vectors are made here.  See :func:`operators.search.search`."""
        q = queries.withColumn("vector", self.embed(F.col("text")))
        return search.search(q, self.records(), self.vectors(), F.lit(now).cast("timestamp"), self.retrieval, scoring, **options)

    def record_retrieval(self, hits: DataFrame, queries: DataFrame, now: datetime) -> int:
        """The explicit sink of what was read: lifts utility when folded."""
        e = search.retrieval_events(hits, queries, "search", F.lit(now).cast("timestamp"))
        return self.append(e.select("kind", "namespace", "actor", "ts", tables.payload(record_ids=F.col("payload.record_ids")).alias("payload")))

    def assemble(self, queries: DataFrame, now: datetime, policy: Assembly = Assembly()) -> DataFrame:
        hits = self.search(queries, now)
        personas = self.records().where((F.col("memory_type") == "working") & (F.col("source.channel") == "persona") & gates.retrievable())
        return search.assemble(search.context_rows(queries, hits, personas), policy)

    def timeline(self, namespace: str, start: datetime, end: datetime) -> DataFrame:
        own = self.records().where((F.col("namespace") == normalise(namespace)) & (F.col("memory_type") == "episodic"))
        return lifecycle.timeline(own, F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))

    def sessions(self, namespace: str | None = None, policy: Sessions = Sessions()) -> DataFrame:
        own = self.records().where(F.col("memory_type") == "episodic")
        return lifecycle.sessions(own if namespace is None else own.where(F.col("namespace") == normalise(namespace)), policy)

    def fact_at(self, probes: DataFrame) -> DataFrame:
        return semantic.facts_as_of(probes, self.records())

    # --- erasure and audit

    def forget(self, record_id: str, namespace: str, now: datetime, hard: bool = False) -> int:
        ns = normalise(namespace)
        if not self.spark.range(1).select(F.lit(ns).alias("namespace")).where(gates.held(self.retention.holds)).isEmpty():
            raise PermissionError(f"{ns!r} is on legal hold")
        row = self.records().where((F.col("record_id") == record_id) & (F.col("namespace") == ns)).limit(1)
        if row.isEmpty() and not hard:
            raise KeyError(f"no record {record_id!r} in {ns!r}")
        one = self.spark.range(1).select(F.lit(ns).alias("namespace"))
        return self.append(self._events(one, "memory.forget", now, record_id=F.lit(record_id), hard=F.lit(hard)))

    def scrub(self, record_ids: Sequence[str], out: str) -> str:
        """Writes the log with those records' contents removed to ``out``, and reads from there on."""
        log.redacted(self.events(), record_ids).withColumn("day", F.to_date("ts")).write.partitionBy("namespace", "day").parquet(out)
        self.path = out
        return out

    def verify_forget(self, record_id: str) -> DataFrame:
        e = self.events()
        return governance.erasure_report(record_id, e, self.records(), self.vectors(), fold.fold_lexical(e))

    def audit_taint(self, record_id: str, namespace: str) -> DataFrame:
        seed = gates.exists_in(self.records(), record_id, normalise(namespace)).select("record_id")
        return governance.tainted(seed, governance.derivations(self.events()))

    # --- skills, plans, reflection

    def add_skill(self, rows: DataFrame, now: datetime, stage: str = "draft", kind: str = "skill") -> int:
        """``rows``: record_id, namespace, content; optional entity (a plan's task)."""
        at = F.lit(now).cast("timestamp")
        entity = F.col("entity") if "entity" in rows.columns else F.lit(None)
        return self._write(rows.select(*tables.record(record_id=F.col("record_id"), namespace=F.col("namespace"), memory_type=F.lit("procedural"), content=F.col("content"), entity=entity, attribute=F.lit(kind), valid_from=at, recorded_at=at, skill_stage=F.lit(stage), status=lifecycle.skill_status(F.lit(stage)), source=tables.source(F.lit("assistant")))), now)

    def record_plan(self, rows: DataFrame, now: datetime) -> int:
        return self.add_skill(rows, now, "staged", "plan")

    def _set(self, rows: DataFrame, now: datetime, transition: str, **fields: Column) -> int:
        pairs = [x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]
        return self.append(self._events(rows, "memory.decay_transition", now, record_id=F.col("record_id"), transition=F.lit(transition), set=F.create_map(*pairs)))

    def promote_skill(self, record_ids: Sequence[str], now: datetime, dry_run_ok: bool = False) -> int:
        own = self.records().where((F.col("memory_type") == "procedural") & F.col("record_id").isin(*record_ids))
        own = own.withColumn("to", lifecycle.next_stage(F.col("skill_stage"), F.col("quarantined"), F.lit(dry_run_ok))).where(F.col("to") != F.col("skill_stage"))
        return self._set(own, now, "promote", skill_stage=F.col("to"), status=lifecycle.skill_status(F.col("to")))

    def deprecate_skill(self, record_ids: Sequence[str], now: datetime) -> int:
        own = self.records().where((F.col("memory_type") == "procedural") & F.col("record_id").isin(*record_ids))
        return self._set(own, now, "deprecate", skill_stage=F.lit("deprecated"), status=F.lit("archived"))

    def skills(self, namespace: str, kind: str | None = None) -> DataFrame:
        own = self.records().where((F.col("namespace") == normalise(namespace)) & (F.col("memory_type") == "procedural") & gates.skill_usable())
        return own if kind is None else own.where(F.col("attribute") == kind)

    def recall_plan(self, tasks: DataFrame, min_similarity: float = 0.6) -> DataFrame:
        """``tasks``: query_id, namespace, text."""
        plans = self.records().where((F.col("memory_type") == "procedural") & (F.col("attribute") == "plan") & gates.skill_usable())
        return lifecycle.recall_plan(tasks.withColumn("vector", self.embed(F.col("text"))), plans.select("record_id", "namespace", self.embed(F.col("entity")).alias("vector")), min_similarity)

    def reflect(self, proposals: DataFrame, now: datetime) -> int:
        """See :func:`operators.lifecycle.reflections`."""
        ok = lifecycle.reflections(proposals, self.records())
        at = F.lit(now).cast("timestamp")
        rows = ok.select(*tables.record(record_id=F.col("reflection_id"), namespace=F.col("namespace"), memory_type=F.lit("reflective"), content=F.col("content"), valid_from=at, recorded_at=at, trust=F.col("trust"), reflection_depth=F.col("reflection_depth"), source=tables.source(F.lit("assistant"))), "member_record_ids")
        return self._write(rows, now, derivation=F.lit("reflection"), member_record_ids=F.col("member_record_ids"))

    # --- links

    def associate(self, links: DataFrame, now: datetime, policy: Links = Links()) -> DataFrame:
        """Appends the links (src, dst, rel, weight, namespace) that are allowed; returns all with ``refused``."""
        judged = graph.links_allowed(links, self.edges(), self.records(), policy)
        self.append(self._events(judged.where("refused is null"), "memory.link", now, src=F.col("src"), dst=F.col("dst"), rel=F.col("rel"), weight=F.col("weight"), reason=F.lit("associate")))
        return judged

    def related(self, seeds: DataFrame, k: int = 8, strategy: str = "ppr") -> DataFrame:
        """``seeds``: query_id, node; live neighbours of the seed's namespace, by personalised rank (``ppr``), distance
        (``bfs``) or the fusion of rank and likeness (``rrf``).  Gated first, then cut to ``k``."""
        records = self.records()
        live = records.where(gates.retrievable()).select(F.col("record_id").alias("node"), "namespace")
        homes = seeds.join(records.select(F.col("record_id").alias("node"), "namespace"), "node").select("query_id", "namespace").distinct()
        hits = None
        if strategy == "rrf":
            texts = seeds.join(records.select(F.col("record_id").alias("node"), "namespace", "content"), "node")
            q = texts.select("query_id", "namespace", self.embed(F.col("content")).alias("vector"))
            hits = vector.topk(q, self.vectors(), 4 * k)
        found = graph.related(self.edges(), seeds, strategy, None, hits)
        from pyspark.sql import Window

        gated = found.join(live, "node").join(homes, ["query_id", "namespace"], "left_semi")
        gated = gated.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
        return gated.where(F.col("rank") <= k).select("query_id", "node", "rank")

    def prune_weakest(self, now: datetime) -> int:
        w = graph.weakest(self.edges()).select("src", "dst", "rel").distinct().withColumn("namespace", F.lit("graph"))
        return self.append(self._events(w, "memory.link", now, src=F.col("src"), dst=F.col("dst"), rel=F.col("rel"), weight=F.lit(0.0), reason=F.lit("prune")))

    # --- watches

    def watch(self, rows: DataFrame, now: datetime) -> int:
        """``rows``: record_id, namespace, content and either due_at or entity (and attribute)."""
        have = set(rows.columns)
        due_at = F.col("due_at") if "due_at" in have else F.lit(None).cast("timestamp")
        entity = F.col("entity") if "entity" in have else F.lit(None).cast("string")
        attribute = F.col("attribute") if "attribute" in have else F.lit(None).cast("string")
        if not rows.where(due_at.isNull() == entity.isNull()).limit(1).isEmpty():
            raise ValueError("a watch needs either a time or an entity")
        at = F.lit(now).cast("timestamp")
        return self._write(rows.select(*tables.record(record_id=F.col("record_id"), namespace=F.col("namespace"), memory_type=F.lit("prospective"), content=F.col("content"), entity=entity, attribute=attribute, valid_from=F.coalesce(due_at, at), recorded_at=at, source=tables.source(F.lit("user")))), now)

    def due(self, now: datetime) -> DataFrame:
        p = F.col("payload")
        conflicts = self.events().where("kind = 'memory.conflict'").select("namespace", p["entity"].alias("entity"), p["attribute"].alias("attribute"), "ts", p["action"].alias("action"))
        return lifecycle.firing(self.records(), conflicts, F.lit(now).cast("timestamp"))

    def acknowledge_watch(self, record_ids: Sequence[str], now: datetime) -> int:
        own = self.records().where((F.col("memory_type") == "prospective") & F.col("record_id").isin(*record_ids) & ~F.col("quarantined") & (F.col("status") != "archived"))
        return self._set(own, now, "acknowledge", status=F.lit("archived"))

    # --- sharing

    def grant(self, grantor: str, grantee: str, scope: Sequence[str] | None, now: datetime) -> int:
        """One live grant for each pair: a new scope replaces the old; None is every type."""
        a, b = normalise(grantor), normalise(grantee)
        if a == b:
            raise ValueError("a namespace needs no grant from itself")
        if scope is not None and (not scope or any(s not in MEMORY_TYPES or s == "shared" for s in scope)):
            raise ValueError("a scope names at least one memory type, and not shared")
        text = None if scope is None else ",".join(sorted(set(scope)))
        at = F.lit(now).cast("timestamp")
        one = self.spark.range(1)
        return self._write(one.select(*tables.record(record_id=F.lit(f"grant:{a}>{b}"), namespace=F.lit(a), memory_type=F.lit("shared"), content=F.lit(text).cast("string"), entity=F.lit(b), attribute=F.lit("grant"), valid_from=at, recorded_at=at, trust=F.lit(0.9), source=tables.source(F.lit("operator")))), now)

    def grants(self) -> DataFrame:
        g = self.records().where((F.col("memory_type") == "shared") & (F.col("attribute") == "grant"))
        return g.select("record_id", F.col("namespace").alias("grantor"), F.col("entity").alias("grantee"), F.when(F.col("content").isNotNull(), F.split("content", ",")).alias("scope"), "status", "quarantined")

    def grants_from(self, grantor: str) -> DataFrame:
        return self.grants().where((F.col("grantor") == normalise(grantor)) & (F.col("status") == "activated"))

    def revoke(self, grantor: str, grantee: str, now: datetime) -> int:
        live = self.grants_from(grantor).where(F.col("grantee") == normalise(grantee))
        if live.isEmpty():
            raise KeyError("there is no such grant")
        return self._set(live.withColumn("namespace", F.col("grantor")), now, "revoke", status=F.lit("archived"))

    def shared_search(self, queries: DataFrame, now: datetime, cap: float = 0.3) -> DataFrame:
        """Each query (query_id, namespace, text) over its own namespace and those granted to it; foreign
        records by vectors alone, with their trust capped."""
        own = self.search(queries, now).select("query_id", "record_id", "score", "trust")
        scopes = governance.grant_scopes(self.grants())
        q = queries.withColumn("vector", self.embed(F.col("text")))
        reach = q.join(scopes, F.col("namespace") == F.col("grantee")).select(F.struct("query_id", "grantor").alias("k"), "query_id", "grantor", "every", "types", "vector")
        keyed = reach.select(F.concat_ws("|", F.col("query_id").cast("string"), "grantor").alias("key"), "query_id", "grantor", "every", "types", "vector")
        hits = vector.topk(keyed.select(F.col("key").alias("query_id"), F.col("grantor").alias("namespace"), "vector"), self.vectors(), self.retrieval.top_k)
        seen = hits.withColumnRenamed("query_id", "key").withColumnRenamed("score", "relevance").join(keyed.drop("vector"), "key").join(self.records(), "record_id").where(gates.retrievable() & (F.col("memory_type") != "shared") & (F.col("every") | F.array_contains("types", F.col("memory_type"))))
        foreign = seen.select("query_id", "record_id", F.round(search.composite(F.col("relevance"), F.lit(now).cast("timestamp")), 9).alias("score"), F.least("trust", F.lit(cap)).alias("trust"))
        from pyspark.sql import Window

        both = own.unionByName(foreign).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "record_id")))
        return both.where(F.col("position") <= self.retrieval.top_k)

    def subscribe(self, reader: str, text: str, now: datetime) -> int:
        ns = normalise(reader)
        at = F.lit(now).cast("timestamp")
        one = self.spark.range(1)
        return self._write(one.select(*tables.record(record_id=F.concat(F.lit("sub-"), F.substring(F.sha2(F.lit(f"{ns}|{text}"), 256), 1, 16)), namespace=F.lit(ns), memory_type=F.lit("shared"), content=F.lit(text), attribute=F.lit("subscription"), valid_from=at, recorded_at=at, source=tables.source(F.lit("user")))), now)

    def subscriptions(self, reader: str | None = None) -> DataFrame:
        s = self.records().where((F.col("memory_type") == "shared") & (F.col("attribute") == "subscription") & gates.retrievable())
        return s if reader is None else s.where(F.col("namespace") == normalise(reader))

    def sync_prompt_versions(self, declared: DataFrame, now: datetime) -> int:
        """Records prompt versions (entity, version, content) that the log does not have."""
        stored = self.records().where(F.col("attribute") == "prompt").select("entity", "version")
        new = lifecycle.fresh_prompts(declared, stored)
        at = F.lit(now).cast("timestamp")
        return self._write(new.select(*tables.record(record_id=F.concat_ws(":", F.lit("prompt"), "entity", "version"), namespace=F.lit("prompts"), memory_type=F.lit("procedural"), content=F.col("content"), entity=F.col("entity"), attribute=F.lit("prompt"), version=F.col("version"), valid_from=at, recorded_at=at, skill_stage=F.lit("active"), source=tables.source(F.lit("operator")))), now)

    def forget_all(self, namespace: str, now: datetime) -> int:
        """Forgets every record of a namespace for good."""
        ns = normalise(namespace)
        if not self.spark.range(1).select(F.lit(ns).alias("namespace")).where(gates.held(self.retention.holds)).isEmpty():
            raise PermissionError(f"{ns!r} is on legal hold")
        own = self.records().where(F.col("namespace") == ns)
        return self.append(self._events(own, "memory.forget", now, record_id=F.col("record_id"), hard=F.lit(True)))

    def prune(self, offsets: DataFrame, now: datetime, out: str) -> str:
        """Writes what a rolling log still needs to ``out``, and reads from there on; ``offsets``: projector, offset."""
        left = log.pruned(self.events(), offsets, F.lit(now).cast("timestamp"), self.retention.retention_days, self.mode)
        left.withColumn("day", F.to_date("ts")).write.partitionBy("namespace", "day").parquet(out)
        self.path = out
        return out

    # --- the sleep cycle

    def sleep(self, now: datetime, sessions: Sessions = Sessions(), extract=None) -> dict[str, int]:
        """The whole cycle, each step's events appended before the next reads: summaries of closed sessions,
        facts from extracted edges (with ``extract``, records to edges), community parents, watches, tiers,
        packing.  Pruning rewrites the log and is :meth:`prune`.  Running it again appends nothing."""
        done = {"summaries": self._summaries(now, sessions)}
        if extract is not None:
            done["facts"] = self.extract_graph(extract(self.records()), now)
        done["parents"] = self.reorganize(now)
        done["watches"] = self.due(now).count()
        before = log.last_seq(self.spark, self.path)
        moved = lifecycle.decay_sweep(self.records(), F.lit(now).cast("timestamp"))
        after = self._set(moved, now, "tier", tier=F.col("new_tier"))
        done["tiers"] = after - before
        packable = lifecycle.compressible(self.records(), self.retention).withColumn("__packed", F.base64(lifecycle.packed(F.col("content"))))
        done["packed"] = self._set(packable, now, "compress", content_zstd=F.col("__packed"), content=F.lit("")) - after
        return done

    def _summaries(self, now: datetime, sessions: Sessions) -> int:
        """Summaries of closed sessions; one that overlaps an older summary of its namespace, as when an
        episode came late and its session has another key, replaces it."""
        at = F.lit(now).cast("timestamp")
        seen = self.events().where("kind = 'memory.consolidate'").select(F.col("payload.session_key").alias("session_key"))
        records = self.records()
        fresh = checkpointed(lifecycle.consolidate(records, at, sessions, seen))
        stored = records.where((F.col("source.channel") == "consolidation") & gates.retrievable())
        stale = checkpointed(lifecycle.superseded_summaries(fresh, stored).groupBy(F.col("old_id").alias("record_id")).agg(F.min("summary_record_id").alias("next")).join(stored.select("record_id", "namespace"), "record_id"))
        rows = fresh.select(*tables.record(record_id=F.col("summary_record_id"), namespace=F.col("namespace"), memory_type=F.lit("episodic"), content=F.col("content"), valid_from=F.col("valid_from"), valid_to=F.col("valid_to"), recorded_at=at, trust=F.col("trust"), instruction_flag=governance.instruction_shaped(F.col("content")), source=tables.source(F.lit("system"), F.lit("consolidation"))), "member_record_ids", "session_key")
        record = F.struct(*[F.col(c) for c in self._record_columns()])
        both = self._events(rows, "memory.write", now, record=record, derivation=F.lit("consolidation"), member_record_ids=F.col("member_record_ids"), session_key=F.col("session_key"))
        audit = self._events(rows, "memory.consolidate", now, session_key=F.col("session_key"), member_record_ids=F.col("member_record_ids"), summary_record_id=F.col("record_id"))
        gone = self._events(stale, "memory.decay_transition", now, record_id=F.col("record_id"), transition=F.lit("superseded"), set=F.create_map(F.lit("status"), F.lit("archived"), F.lit("evolve_to"), F.col("next"), F.lit("superseded_at"), at.cast("string")))
        self.append(both.withColumn("batch_pos", F.lit(0)).unionByName(audit.withColumn("batch_pos", F.lit(1))).unionByName(gone.withColumn("batch_pos", F.lit(2))))
        return fresh.count()

    def reorganize(self, now: datetime) -> int:
        """A summary parent for each community whose members changed, linked to them; parents of
        communities that are no more are archived and their links ended.  Returns how many parents are new."""
        at = F.lit(now).cast("timestamp")
        e = self.events()
        p = F.col("payload")
        made = e.where((F.col("kind") == "memory.write") & (p["derivation"] == "community")).select(p["record"]["record_id"].alias("record_id"), p["record"]["namespace"].alias("namespace"), p["session_key"].alias("community_key")).distinct()
        edges = checkpointed(self.edges())
        if edges.where(gates.live_link()).isEmpty() and made.isEmpty():
            return 0
        records = checkpointed(self.records())
        live = records.where(gates.retrievable()).select("record_id")
        parents = checkpointed(made.join(live, "record_id", "left_semi"))
        members = graph.communities(edges.where(gates.live_link()))
        found = checkpointed(graph.reorganize(members, records))
        fresh = found.join(parents.select("community_key"), "community_key", "left_anti").withColumn("record_id", F.concat(F.lit("c-"), F.substring("community_key", 1, 16)))
        stale = parents.join(found.select("community_key"), "community_key", "left_anti").select("record_id", "namespace")
        rows = fresh.select(*tables.record(record_id=F.col("record_id"), namespace=F.col("namespace"), memory_type=F.lit("associative"), content=F.col("content"), valid_from=at, recorded_at=at, trust=F.col("trust"), instruction_flag=governance.instruction_shaped(F.col("content")), source=tables.source(F.lit("system"), F.lit("reorganize"))), "member_record_ids", "community_key")
        record = F.struct(*[F.col(c) for c in self._record_columns()])
        write = self._events(rows, "memory.write", now, record=record, derivation=F.lit("community"), member_record_ids=F.col("member_record_ids"), session_key=F.col("community_key"))
        link = lambda d, w: self._events(d, "memory.link", now, src=F.col("src"), dst=F.col("dst"), rel=F.lit("community"), weight=F.lit(w), reason=F.lit("reorganize"))
        new = link(fresh.select(F.col("record_id").alias("src"), F.explode("member_record_ids").alias("dst"), "namespace"), 1.0)
        old = edges.where("rel = 'community' and weight > 0").join(stale.withColumnRenamed("record_id", "src"), "src").select("src", "dst", "namespace")
        gone = self._events(stale, "memory.decay_transition", now, record_id=F.col("record_id"), transition=F.lit("superseded"), set=F.create_map(F.lit("status"), F.lit("archived"), F.lit("superseded_at"), at.cast("string")))
        events = write.withColumn("batch_pos", F.lit(0))
        for k, part in enumerate((new, link(old, 0.0), gone), 1):
            events = events.unionByName(part.withColumn("batch_pos", F.lit(k)))
        self.append(events)
        return fresh.count()

    def extract_graph(self, extracted: DataFrame, now: datetime, floor: float = 0.0) -> int:
        """Facts from extracted edges (see :func:`operators.semantic.graph_facts`) by the semantic write path; known ones
        are passed over.  Records that came by it are not read again by an extractor that leaves out channel ``write_pipeline``."""
        at = F.lit(now).cast("timestamp")
        facts = semantic.graph_facts(extracted, floor)
        rid = F.concat(F.lit("g-"), F.substring(F.sha2(F.concat_ws("|", "namespace", "entity", "attribute", "content"), 256), 1, 24))
        rows = facts.select(*tables.record(record_id=rid, namespace=F.col("namespace"), memory_type=F.lit("semantic"), content=F.col("content"), entity=semantic_entity(F.col("entity")), attribute=F.col("attribute"), valid_from=at, recorded_at=at, trust=F.col("trust"), source=tables.source(F.lit("user"), F.lit("write_pipeline"))))
        rows = checkpointed(rows.join(self.events().where("kind = 'memory.write'").select(F.col("payload.record.record_id").alias("record_id")), "record_id", "left_anti"))
        if rows.isEmpty():
            return 0
        self._write_semantic(rows, checkpointed(self.records()), now)
        return rows.count()


def semantic_entity(name: Column) -> Column:
    from .functions.text import canonical_entity

    return canonical_entity(name)
