from lakeproof.sources import manifests


def test_dependencies(spark):
    files = [
        ("a/package.json", '{"dependencies": {"axios": "^1"}, "devDependencies": {"chai-http": "4"}}'),
        ("requirements.txt", "pytest-cov==4.1\n# note\nhttpx>=0.2\nflask[async]\n"),
        ("pom.xml", "<dependencies><dependency><groupId>g</groupId><artifactId>junit-jupiter</artifactId><version>5</version></dependency><dependency><artifactId>x</artifactId></dependency></dependencies>"),
        ("build.gradle", "dependencies {\n  testImplementation 'io.kotest:kotest-core:5.1'\n}"),
        ("Gemfile", "gem 'rspec-rails', '~> 6'\ngem \"rack\""),
        ("go.mod", "module m\nrequire github.com/a/b v1.2.3"),
        ("Pipfile", '[packages]\nrequests = "*"'),
        ("other.txt", "x"),
        ("broken/package.json", "{"),
    ]
    got = {(r.file, r.name): (r.version, r.scope, r.category) for r in manifests.dependencies(spark.createDataFrame(files, "file string, content string")).collect()}
    assert got == {
        ("a/package.json", "axios"): ("^1", "production", "unknown"), ("a/package.json", "chai-http"): ("4", "development", "assertionLibrary"), ("requirements.txt", "pytest-cov"): ("4.1", "production", "testFramework"),
        ("requirements.txt", "httpx"): ("0.2", "production", "unknown"), ("requirements.txt", "flask"): (None, "production", "unknown"), ("pom.xml", "junit-jupiter"): ("5", "production", "testFramework"), ("pom.xml", "x"): (None, "production", "unknown"),
        ("build.gradle", "io.kotest:kotest-core"): ("5.1", "production", "unknown"), ("Gemfile", "rspec-rails"): ("~> 6", "production", "testFramework"), ("Gemfile", "rack"): (None, "production", "unknown"),
        ("go.mod", "github.com/a/b"): ("v1.2.3", "production", "unknown"), ("Pipfile", "requests"): ("*", "production", "unknown"),
    }
    paths = spark.createDataFrame([("x/Jenkinsfile",), (".gitlab-ci.yml",)], "path string")
    assert manifests.ci_platform(paths).first().platform == "gitlab-ci"
    assert manifests.ci_platform(paths.limit(0)).first().platform is None
