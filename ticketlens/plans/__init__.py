"""The models: staging, fact, insights, dashboard and narrative."""
