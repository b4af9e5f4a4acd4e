"""Where payloads come from: folders, stored listings, caches, plug-ins."""
