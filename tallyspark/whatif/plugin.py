"""What-if as an engine plugin: extensions.whatif, and saved scenarios."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame

from ..engine import Caller
from ..errors import SpecError, VersionConflict, pointer
from ..functions.plugins import BindContext, Bound, PlanContext, Plugin, Registry, TransformDef
from ..plans.request import DatasetRef, fingerprint
from ..types import ValueType
from .scenarios import ScenarioManager, ScenarioStore
from .steps import Step, WhatIf
from .transform import StepsPlan


class BoundSteps(Bound):
    def __init__(self, steps: Sequence[Step], strict: bool, version: str | None = None, saved: int = 0, scenario: dict | None = None) -> None:
        self.steps, self.strict, self.version, self.saved, self.scenario = list(steps), strict, version, saved, scenario
        self.identity = fingerprint([self.steps, strict, saved, scenario])

    def plan(self, env: dict[str, ValueType], df: DataFrame, context: PlanContext) -> StepsPlan:
        plan = StepsPlan(self.steps, self.strict, env, df, context, saved=self.saved)
        if self.scenario:
            plan.meta = lambda own=plan.meta: {**own(), "scenario": self.scenario}
        return plan


class WhatIfPlugin(Plugin):
    name, version = "whatif", "1"

    def __init__(self, store: ScenarioStore | None = None) -> None:
        self.scenarios = ScenarioManager(store)

    def register(self, registry: Registry) -> None:
        registry.add_transform(TransformDef("whatif", WhatIf.read, self.bind, "cell overrides, shocks and formula columns"))
        from ..serving.routes import whatif_routes

        registry.add_routes(whatif_routes(self))

    def attach(self, engine: Any) -> None:
        self.engine = engine
        self.scenarios.engine, self.scenarios.check = engine, self.check

    def bind(self, block: WhatIf, context: BindContext) -> Bound:
        if block.scenario is None:
            return BoundSteps(block.steps, block.strict_edits)
        ref = block.scenario
        held = self.scenarios.get(ref.id, context.caller)
        where = pointer(context.path, "scenario")
        if held.dataset.id != context.dataset.id:
            raise SpecError(f"scenario {ref.id} is over dataset {held.dataset.id}", "dataset_mismatch", where)
        if context.dataset.version not in (None, held.dataset.version):
            raise VersionConflict(f"scenario {ref.id} is over version {held.dataset.version}", path=where)
        log = self.scenarios.log(ref.id, ref.version, context.caller)
        return BoundSteps([*(e.step for e in log), *block.steps], block.strict_edits, held.dataset.version, len(log), {"id": ref.id, "version": len(log)})

    def check(self, ref: DatasetRef, steps: Sequence[Step], caller: Caller) -> None:
        """Plans steps against a version as all of it, without looking for their rows."""
        if not hasattr(self, "engine"):
            raise SpecError("the plugin is in no engine", "not_attached")
        dataset = self.engine.catalog.get(ref.id, ref.version)
        env = dataset.schema.types
        StepsPlan(steps, False, env, dataset.df, PlanContext(self.engine, dataset, env, caller, ""), check_edits=False, saved=len(steps))
