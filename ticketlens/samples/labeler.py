"""A deterministic labeller with planted faults, standing in for a remote one."""

from __future__ import annotations

import json
import sys

from pyspark import cloudpickle

from ticketlens.operators.labeling import LabelRequest

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Ticket columns the labeller looks at besides id and labels.
CONTEXT = ["channel", "priority"]


def _rows_for(ticket: dict) -> list[dict]:
    k = int(ticket["ticket_id"].split("-")[1])
    if k % 53 == 0:
        return []
    urgency = int(ticket["priority"])
    if k % 67 == 0:
        urgency = 9
    if k % 71 == 0:
        urgency = "2"
    row = {
        "ticket_id": ticket["ticket_id"],
        "primary_label": "Other" if k % 61 == 0 else ticket["primary_label"],
        "secondary_label": ticket["secondary_label"],
        "sentiment": ticket["sentiment"],
        "urgency": urgency,
        "one_line_summary": f"{ticket['secondary_label']} reported by {ticket['channel']}",
        "confidence": 0.5,
    }
    return [row, {**row, "urgency": 1}] if k % 59 == 0 else [row]


def sample_labeler(request: LabelRequest) -> str:
    """Confirm the tickets' labels, except for the faults of the fixture rules."""
    batch = request.batch_id
    if batch % 11 == 5:
        return "Sorry, I cannot help with that."
    rows = [row for ticket in request.tickets for row in _rows_for(ticket)]
    if batch % 17 == 3:
        rows.append(
            {
                "ticket_id": f"TKT-UNKNOWN-{batch}",
                "primary_label": "Billing",
                "secondary_label": "Failed Payment",
                "sentiment": "Neutral",
                "urgency": 1,
                "one_line_summary": "Unknown ticket",
            }
        )
    reply = json.dumps(rows)
    if batch % 11 == 6:
        return reply + " I hope this helps."
    if batch % 11 == 7:
        return json.dumps(rows[0] if rows else {})
    if batch % 13 == 7:
        return f"```json\n{reply}\n```"
    return reply


def careful_labeler(request: LabelRequest) -> str:
    """Always answers, in one plain array; only its per-ticket faults remain."""
    return json.dumps([row for ticket in request.tickets for row in _rows_for(ticket)])


def sample_writer(prompt: str) -> str:
    """A narrative that just lists the figures of the prompt."""
    return "; ".join(line[2:] for line in prompt.splitlines() if line.startswith("* "))
