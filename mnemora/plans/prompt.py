"""Packing ranked entries into a prompt of a token budget (at most a few rows, on the driver)."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from mnemora.functions.tokens import TokenCounter


@dataclass
class _Budget:
    left: int
    counter: TokenCounter
    parts: list[str] = field(default_factory=list)

    def add(self, text: str, most: int | None = None) -> bool:
        cost = self.counter.count(text)
        if cost > (self.left if most is None else most):
            return False
        self.parts.append(text)
        self.left -= cost
        return True

    def add_cut(self, text: str) -> bool:
        short = self.counter.cut(text, self.left - 5)
        if not short:
            return False
        self.parts.append(short + "...\n")
        self.left -= self.counter.count(self.parts[-1])
        return True


def _age(hours: float) -> str:
    if hours < 1:
        return f"{hours * 60:.0f}分钟前"
    return f"{hours:.1f}小时前" if hours < 24 else f"{hours / 24:.1f}天前"


def pack(entries: list[dict], budget: int, counter: TokenCounter | None = None, related: list[str] = (), hidden: list[str] = (), chains: list[dict] = ()) -> tuple[str, dict]:
    """(prompt, {entry id: layers loaded}); a layer that doesn't fit is skipped and costs nothing."""
    b = _Budget(budget, counter or TokenCounter())
    loaded: dict[str, list[str]] = {}
    b.add("[记忆上下文]\n", budget - 1)
    for i, e in enumerate(entries):
        layers = loaded.setdefault(e["id"], [])
        if b.left <= 20:
            break
        head = f"\n--- 记忆 #{i + 1} "
        if e.get("source"):
            head += f"[来源:{e['source']}] "
        if e.get("timestamp"):
            head += f"[{datetime.fromtimestamp(e['timestamp'], timezone.utc):%Y-%m-%d %H:%M}] "
        if not b.add(f"{head}[{_age(e['age_hours'])}] ---\n", b.left - 1):
            break
        fixed = [("topic", "主题", e.get("topic")), ("keywords", "关键词", ", ".join(e.get("keywords") or []))]
        layers += [name for name, label, value in fixed if value and b.add(f"{label}: {value}\n")]
        for name, label, value, least, cut in (("summary", "摘要", e.get("summary"), 0, 30), ("body", "详情", e.get("body") if i == 0 else None, 50, 80)):
            if value and b.left > least:
                if b.add(f"{label}: {value}\n"):
                    layers.append(name)
                elif b.left > cut and b.add_cut(f"{label}: {value}"):
                    layers.append(f"{name}(截断)")
    if related and b.left > 20:
        b.add(f"\n[关联概念] {', '.join(related[:8])}\n")
    if b.left > 30:
        lines = [f"[隐藏关联] {', '.join(hidden[:6])}"] if hidden else []
        if chains:
            lines.append("[推理路径]")
            lines += [f"  {' → '.join(c['path'])} (关联强度:{c['total_weight']:.3f})" for c in chains[:3]]
        if lines:
            b.add("\n" + "\n".join(lines) + "\n")
    return "".join(b.parts), loaded
