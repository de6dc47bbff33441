"""Rule libraries: plain data that the plan builder turns into Columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Condition:
    name: str = ""
    css: str = ""
    regex: str = ""
    rule_css: str = ""

    @classmethod
    def from_dict(cls, d: dict) -> Condition:
        return cls(
            name=d.get("ecName") or "",
            css=d.get("ecCSSSelector") or "",
            regex=d.get("ecTextCondition") or "",
            rule_css=d.get("ecRuleCSSSelector") or "",
        )


@dataclass(frozen=True)
class Rule:
    name: str
    descr: str = ""
    url_patterns: tuple[str, ...] = ()
    target: str = "html"
    css: str = ""
    attr: str = ""
    content_regex: str = ""
    pre_type: str = "ANY"
    pre_expr: str = ""
    pre: tuple[Condition, ...] = ()
    match_pre: tuple[Condition, ...] = ()
    returns_more: bool = False
    match_pos: int = -1
    post_css: tuple[str, ...] = ()
    value_names: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, d: dict) -> Rule:
        def text(key, default=""):
            return default if d.get(key) is None else d[key]

        def items(key):
            return tuple(d.get(key) or ())

        pos = d.get("ruleReturnedMatchPos")
        return cls(
            name=text("ruleName"),
            descr=text("ruleDescription"),
            url_patterns=items("ruleURLActivationCondition"),
            target=text("ruleTarget", "html"),
            css=text("ruleCSSSelector"),
            attr=text("ruleTargetAttribute"),
            content_regex=text("ruleContentCondition"),
            pre_type=text("rulePreconditionType", "ANY"),
            pre_expr=text("rulePreconditionExpression"),
            pre=tuple(Condition.from_dict(c) for c in items("rulePreconditions")),
            match_pre=tuple(Condition.from_dict(c) for c in items("ruleMatchPreconditions")),
            returns_more=bool(d.get("ruleReturnsMore") or False),
            match_pos=-1 if pos is None else int(pos),
            post_css=items("rulePostCSSSelector"),
            value_names=items("ruleReturnedValueNames"),
            remove=items("ruleRemoveChars"),
        )

    @property
    def shape(self) -> str:
        """script | text | texts | named | records | attr — how matches become values."""
        if self.target == "js":
            return "script"
        if self.attr != "text":
            return "attr"
        if not self.returns_more:
            return "text"
        if not self.value_names:
            return "texts"
        return "records" if self.post_css else "named"

    @property
    def record_fields(self) -> tuple[tuple[str, str], ...]:
        """(field, sub-selector) pairs, cut to the shorter list; a repeated field keeps its last selector."""
        return tuple({n: c for c, n in zip(self.post_css, self.value_names)}.items())


@dataclass(frozen=True)
class Library:
    rules: tuple[Rule, ...]
    csv_cols: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    min_filled: float = -1.0
    descr: str = field(default="")

    @classmethod
    def from_dict(cls, d: dict) -> Library:
        minimum = d.get("allowedMinimumFilled")
        return cls(
            rules=tuple(Rule.from_dict(r) for r in d.get("library") or ()),
            csv_cols=tuple(dict.fromkeys(d.get("csvLineFormat") or ())),
            required=tuple(d.get("requiredFilledFields") or ()),
            min_filled=-1.0 if minimum is None else float(minimum),
            descr=d.get("libraryDescription") or "",
        )

    def rule(self, name: str) -> Rule | None:
        """First rule of that name."""
        return next((r for r in self.rules if r.name == name), None)

    def only(self, name: str) -> Library:
        """The library cut to one rule."""
        rule = self.rule(name)
        if rule is None:
            raise KeyError(f"no rule named {name!r}")
        return replace(self, rules=(rule,))

    def with_rule(self, rule: Rule | dict) -> Library:
        return replace(self, rules=self.rules + (Rule.from_dict(rule) if isinstance(rule, dict) else rule,))
