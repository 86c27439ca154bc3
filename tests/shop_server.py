"""A shop on this machine: pages of products with their number in a header, variations, and updates of them, all counted."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


class ShopServer:
    def __init__(self, products, variations, totals=True):
        """products: dicts. variations: {product id: [dicts]}. `on_put(n)` is called before the n-th update is answered."""
        self.products, self.variations, self.totals = products, variations, totals
        self.asked, self.puts, self.on_put = Counter(), [], lambda n: None
        self.lock = threading.Lock()
        outer = self

        class Answer(BaseHTTPRequestHandler):
            def reply(self, code, value, **headers):
                body = json.dumps(value).encode()
                self.send_response(code)
                self.send_header("Content-Length", str(len(body)))
                for k, v in headers.items():
                    self.send_header(k.replace("_", "-"), str(v))
                self.end_headers()
                self.wfile.write(body)

            def found(self):
                parts = self.path.split("?")[0].rstrip("/").split("/")
                product, variation = int(parts[-3]), int(parts[-1])
                return next((v for v in outer.variations.get(product, []) if v["id"] == variation), None)

            def do_GET(self):
                with outer.lock:
                    outer.asked[self.path] += 1
                path, _, query = self.path.partition("?")
                asked = dict(x.split("=") for x in query.split("&")) if query else {}
                if path.split("/")[-2] == "variations":
                    found = self.found()
                    return self.reply(200, found) if found else self.reply(404, "none")
                every = outer.variations.get(int(path.split("/")[-2]), []) if path.endswith("/variations") else outer.products
                size, page = int(asked["per_page"]), int(asked["page"])
                extra = {"X_WP_TotalPages": -(-len(every) // size)} if outer.totals else {}
                self.reply(200, every[size * (page - 1) : size * page], **extra)

            def do_PUT(self):
                payload = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                found = self.found()
                with outer.lock:
                    outer.puts.append((self.path.split("/variations/")[-1], payload))
                    n = len(outer.puts)
                    if found is not None:
                        found.update(payload)
                outer.on_put(n)
                self.reply(200, found) if found is not None else self.reply(404, "none")

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def close(self):
        self.server.shutdown()
