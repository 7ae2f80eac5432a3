"""A labeller and a writer that the job runner loads by name."""

import json


def label(request):
    return json.dumps(
        [
            {**t, "urgency": 3, "one_line_summary": "Seen", "sentiment": "Angry"}
            for t in request.tickets
        ]
    )


def write(prompt):
    return f" {len(prompt.splitlines())} lines "
